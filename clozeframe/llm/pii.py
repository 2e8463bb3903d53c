"""Personal data by a semi-Markov conditional random field over candidate spans.

Patterns give base spans.  They fail where entities touch: digits of a phone and a card number in a row are one match that no check
accepts.  So the text around digits and at signs is cut into atoms (runs of letters, runs of digits, single other
characters), and every span of bounded length that can be an entity of a kind is a candidate segment, scored as a whole by its
shape, checks and surroundings.  Dynamic programming over the atoms chooses boundaries and kinds jointly.  The weights are learnt
from base spans of a bounded sample of texts, also set side by side, so that the model sees entities that touch.
Segments with a high posterior that overlap no base span are added to the base spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import giving_back, hash_sample, kept, slices

KINDS = ("email", "ip", "card", "phone")
# Texts and regions of text learnt from at most, in the order of a hash.
TEXTS, SAMPLE = 5_000, 1_200
EPOCHS, RATE, DECAY = 12, 0.5, 1e-3
# Atoms of a segment at most.
LONGEST = 24
POSTERIOR = 0.9

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start at the first digit of a run, so the look-behind changes no result but keeps the scan linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
# Stretches that can hold an entity: digits with separators, or what stands around an at sign.
NUMERIC = re.compile(r"[+(]?[0-9][0-9 ().+-]{5,}[0-9]")
AT = re.compile(r"[^\s@]{1,64}(?:@| ?[\[(]at[\])] ?)[^\s@]{1,128}")
REGION = 160

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of pattern matches that pass their checks, in order."""
    found: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at - (len(part := text[free:at]) - len(part.rstrip(LOCAL)))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end(), "email"))
        free = domain.end() if domain else at + 1
        at = text.find("@", max(free, at + 1))
    for m in IP.finditer(text):
        if all(map(byte_part, m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches for the field, joined where they touch, cut between atoms where they are very long."""
    marks = [m.span() for m in NUMERIC.finditer(text)]
    if "@" in text or "[at]" in text or "(at)" in text:
        marks += [m.span() for m in AT.finditer(text)]
    joined: list[list[int]] = []
    for start, end in sorted(marks):
        if joined and start <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return [(a, b) for a, b in joined]


def _groups(span: str) -> str:
    return "-".join(str(len(g)) for g in re.findall(r"[0-9]+", span)[:6])


def features(kind: str, span: str, left: str, right: str) -> list[str] | None:
    """Names of what holds for the span as this kind; None where it cannot be one."""
    out = [f"{kind}"]
    digits = DIGITS.sub("", span)
    if kind == "email":
        m = re.fullmatch(r"([A-Za-z0-9._%+-]+)(@| ?[\[(]at[\])] ?)([A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+)", span)
        if not m:
            return None
        top = re.split(r"[.\])]", m[3])[-1].strip()
        out += [f"email sign {m[2].strip()}", f"email top {'letters' if top.isalpha() else 'other'}", f"email top {min(len(top), 7)}"]
        out += ["email cut left"] * bool(left and left in LOCAL) + ["email cut right"] * bool(right and (right.isalnum() or right == "-"))
        return out
    if kind == "ip":
        parts = span.split(".")
        if len(parts) != 4 or not all(p.isdecimal() and p.isascii() and byte_part(p) for p in parts):
            return None
        out += ["ip zero"] * any(len(p) > 1 and p[0] == "0" for p in parts)
        out += ["ip cut"] * bool((left and (left.isalnum() or left in ".-")) or (right and (right.isalnum() or right == "-")))
        return out
    if kind == "card":
        if not 12 <= len(digits) <= 19 or not re.fullmatch(r"[0-9]+(?:[ -][0-9]+)*", span) or not luhn(digits):
            return None
        out += [f"card digits {len(digits)}", f"card groups {_groups(span)}", f"card first {digits[0]}", f"card marks {len(set(span) - set('0123456789'))}"]
    else:
        if not re.fullmatch(r"\+?[0-9(][ ().0-9-]*[0-9]", span) or span.count("(") != span.count(")"):
            return None
        plus = span[0] == "+"
        if not (9 <= len(digits) <= 15 if plus else re.fullmatch(r"(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}", span)):
            return None
        out += [f"phone plus {plus}", f"phone digits {len(digits)}", f"phone groups {_groups(span)}", f"phone brackets {'(' in span}"]
    if left and left.isalnum() or right and right.isalnum():
        out.append(f"{kind} cut")
    return out


class Region:
    """Candidate segments of one stretch of text."""

    def __init__(self, text: str, start: int, end: int):
        atoms = [(m.start() + start, m.end() + start) for m in ATOM.finditer(text[start:end])]
        self.size = len(atoms)
        self.segments: list[tuple[int, int, Span, list[str]]] = []
        for i, (a, _) in enumerate(atoms):
            c = text[a]
            if not (c.isalnum() and c.isascii() or c in "+(._%-"):
                continue
            for j in range(i + 1, min(i + LONGEST, self.size) + 1):
                b = atoms[j - 1][1]
                if not (text[b - 1].isalnum() or text[b - 1] in "-"):
                    continue
                span = text[a:b]
                signs = "@" in span or "at" in span
                for kind in KINDS:
                    if (kind == "email") != signs:
                        continue
                    names = features(kind, span, text[a - 1 : a] if a else "", text[b : b + 1])
                    if names is not None:
                        self.segments.append((i, j, (a, b, kind), names))


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def posteriors(region: Region, weights: dict[str, float]) -> tuple[list[float], list[int]]:
    """Posterior of every candidate segment, and the segments of the best labelling; other atoms score zero."""
    n = region.size
    score = [sum(weights.get(f, 0.0) for f in names) for _, _, _, names in region.segments]
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _, _) in enumerate(region.segments):
        ends[j].append(k)
        starts[i].append(k)
    forward, best, back = [0.0] * (n + 1), [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        forward[j], best[j] = forward[j - 1], best[j - 1]
        if ends[j]:
            forward[j] = _logsum([forward[j - 1]] + [forward[region.segments[k][0]] + score[k] for k in ends[j]])
            for k in ends[j]:
                value = best[region.segments[k][0]] + score[k]
                if value > best[j]:
                    best[j], back[j] = value, k
    behind = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        if starts[i]:
            behind[i] = _logsum([behind[i + 1]] + [score[k] + behind[region.segments[k][1]] for k in starts[i]])
    chance = [math.exp(forward[i] + score[k] + behind[j] - forward[n]) for k, (i, j, _, _) in enumerate(region.segments)]
    chosen, j = [], n
    while j > 0:
        if back[j] >= 0:
            chosen.append(back[j])
            j = region.segments[back[j]][0]
        else:
            j -= 1
    return chance, chosen[::-1]


def fit(samples: list[tuple[str, set[Span]]]) -> dict[str, float]:
    """Weights that maximise the likelihood of the given spans (adaptive gradient steps, decayed)."""
    data = [(Region(text, 0, len(text)), gold) for text, gold in samples]
    data = [(r, gold) for r, gold in data if r.segments]
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(EPOCHS):
        for region, gold in data:
            chance, _ = posteriors(region, weights)
            gradient: dict[str, float] = {}
            for (_, _, span, names), p in zip(region.segments, chance, strict=True):
                g = float(span in gold) - p
                for f in names:
                    gradient[f] = gradient.get(f, 0.0) + g
            for f, g in gradient.items():
                g -= DECAY * weights.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) + RATE * g / math.sqrt(squares[f] + 1e-8)
    return weights


def examples(texts: list[str]) -> list[tuple[str, set[Span]]]:
    """Regions with their base spans; also pairs of them set side by side, in either distance."""
    one: list[tuple[str, set[Span]]] = []
    for text in texts:
        spans = [s for s in base_spans(text) if not any(o[0] <= s[0] and s[1] <= o[1] and o != s for o in base_spans(text))]
        one.append((text, set(spans)))
    joined = []
    for k in range(len(one) - 1):
        (a, x), (b, y) = one[k], one[k + 1]
        if x and y:
            gap = " "
            joined.append((a + gap + b, x | {(s + len(a + gap), e + len(a + gap), kind) for s, e, kind in y}))
    return one + joined


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` regions of the texts; regions over ``REGION`` characters are not learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t[a:b] for t in batch.column("text").to_pylist() for a, b in regions(t) if b - a <= REGION]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["region"])

    likely = docs.where(F.col("text").rlike(r"[0-9@]"))
    # At most ``TEXTS`` ids: a bounded broadcast.
    chosen = kept(hash_sample(likely.select("doc_id").distinct(), "doc_id", TEXTS))
    found = likely.join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(giving_back(run), "region string").distinct()
    rows = hash_sample(found, "region", sample).orderBy(F.xxhash64("region"), "region").collect()
    return fit(examples([r[0] for r in rows]))


def added_spans(text: str, base: list[Span], weights: dict[str, float]) -> list[Span]:
    """Segments of the best labelling with a high posterior that overlap no base span."""
    out = []
    for start, end in regions(text):
        touching = [s for s in base if s[0] < end and s[1] > start]
        # A region that is one base span has nothing to add.
        if len(touching) == 1 and touching[0][0] <= start and touching[0][1] >= end:
            continue
        region = Region(text, start, end)
        if not region.segments:
            continue
        chance, chosen = posteriors(region, weights)
        for k in chosen:
            span = region.segments[k][2]
            if chance[k] >= POSTERIOR and not any(s[0] < span[1] and s[1] > span[0] for s in touching):
                out.append(span)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def personal_data(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all, as kind:start:end), n_added of every document.

    NULL and empty texts have no span.  Repeated rows come back as often as given, other columns are ignored, an empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    weights = learn(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                likely = pc.match_substring_regex(texts, r"[0-9@]|[\[(]at[\])]").to_numpy(zero_copy_only=False)
                rows = [nothing] * part.num_rows
                for i in likely.nonzero()[0].tolist():
                    text = texts[i].as_py()
                    base = base_spans(text)
                    added = added_spans(text, base, weights)
                    kinds = [s[2] for s in base]
                    rows[i] = (*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))
                columns = [list(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(names[1:], columns, strict=True)]], names
                )

    return docs.mapInArrow(giving_back(run), SCHEMA)
