"""NULLs, empty and long texts, ties, repeated rows, empty tables, clashing columns; hot groups by small limits."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from clozeframe.llm import bestfit, divergence, hnsw, langid, linededup, middle, mixing, outliers, packing, pii, rules, simhash, tokens, toxicity
from clozeframe.llm.graph import components
from test_queries import LOWER, WORD, fingerprint, reachable

# Columns that operators use inside or return.
EXTRA = ["row", "stats", "score", "node", "size", "target", "stage", "drop", "bits", "fingerprint", "shuffle", "n"]
DOCS = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType())]
    + [StructField(c, StringType()) for c in EXTRA]
)
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
LONG = " ".join(f"word{i % 997} and" for i in range(20_000))


def frame(spark, rows, schema=DOCS):
    width = len(schema.fields)
    return spark.createDataFrame([tuple(r) + ("x",) * (width - len(r)) for r in rows], schema)


ROWS = [
    (1, "The cat sat on the mat. Call +1 (269) 555-3296 4539578763621486 now", "en", "a"),
    (1, "The cat sat on the mat. Call +1 (269) 555-3296 4539578763621486 now", "en", "a"),
    (2, None, None, None),
    (3, "", "de", "b"),
    (4, " \t\n \x0b\x0c\r", None, "a"),
    (None, "no id here", "en", None),
    (None, None, None, None),
    (5, LONG, "en", "a"),
    (6, "l'été, où ça? ÀÉ 12345", "fr", "b"),
    (7, "\x1c weird space <|endoftext|> \U0001f600 é", None, "b"),
    (8, "111 222 333", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return frame(spark, [(1, 1, 0), (3, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (1, 0, 1)], LABELS)


OPERATORS = {
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "outliers": lambda d, lab: outliers.quality_rules(d),
    "toxicity": lambda d, lab: toxicity.scored(d, lab),
    "lines": lambda d, lab: linededup.cleaned(d),
    "mixing": lambda d, lab: mixing.taken_words(d),
    "language": lambda d, lab: langid.predicted(d),
    "personal": lambda d, lab: pii.personal_data(d),
    "rules": lambda d, lab: rules.scored(d, lab),
    "middle": lambda d, lab: middle.transform(d),
}
# Operators whose rows are not documents.
OTHERS = {
    "packing": lambda d, lab: packing.pack(d),
    "bestfit": lambda d, lab: bestfit.pack(d),
    "divergence": lambda d, lab: divergence.audit(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(docs, labels, name):
    got = OPERATORS[name](docs, labels).toPandas()
    assert sorted(got.doc_id.dropna()) == [1, 1, 2, 3, 4, 5, 6, 7, 8] and got.doc_id.isna().sum() == 2


@pytest.mark.parametrize("name", [*OPERATORS, *OTHERS])
def test_empty_table(empty, labels, name):
    assert (OPERATORS | OTHERS)[name](empty, labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["packing", "bestfit"])
def test_pieces_of_nulls_and_repeated_rows(docs, name):
    """Every row is packed once: pieces of a document that is given twice come twice, a NULL text is the end id alone."""
    got = OTHERS[name](docs, None).toPandas()
    assert got[got.doc_id == 2][["start", "length", "offset"]].values[:, :2].tolist() == [[0, 1]]
    once = got[got.doc_id == 8].length.sum()
    ones = got[got.doc_id == 1]
    assert ones.length.sum() % 2 == 0 and (ones.start == 0).sum() == 2 and once > 1
    assert got[got.doc_id.isna()].start.eq(0).sum() == 2
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]


def test_stages_keep_columns(docs, empty, labels):
    for d in (docs, empty):
        for out in (
            toxicity.without_toxic(d, labels), linededup.without_recurring_lines(d).drop("_line_drops"),
            simhash.one_of_each(d), mixing.resample(d),
        ):
            assert out.columns == d.columns and out.dtypes == d.dtypes
            out.count()


def test_simhash_of_wordless_texts(docs):
    got = simhash.near_duplicates(docs).toPandas()
    zero = got[got.fingerprint == "0" * 16]
    assert set(zero.component_id) == {2} and {2, 3, 4} <= set(zero.doc_id.dropna())


@pytest.mark.parametrize("pairwise", [1, 64])
def test_crowded_blocks_give_the_same_components(spark, pairwise):
    rng = random.Random(3)
    prints = {0, (1 << 63) - 1, -1}
    for _ in range(12):
        base = rng.getrandbits(63)
        for _ in range(25):
            prints.add(base ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    prints = sorted(prints)
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint bigint").cache(), pairwise)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    mask = (1 << 64) - 1
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & mask).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


@pytest.mark.parametrize("pairwise", [1, 64])
def test_one_of_each_component_stays(spark, pairwise):
    """Chained families: each copy changes one word of the copy before it."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(12):
        words = rng.choices(vocabulary, k=300)
        for _ in range(30 if family == 0 else 4):
            rows.append((len(rows), " ".join(words), "en", "a"))
            words[rng.randrange(300)] = "changed"
    want = reachable({i: fingerprint(t) for i, t, *_ in rows})
    got = simhash.one_of_each(frame(spark, rows).repartition(4), pairwise=pairwise).select("doc_id").collect()
    assert {r["doc_id"] for r in got} == set(want.values()) and len(set(want.values())) < len(rows)


def test_repeated_rows_leave_one(spark):
    got = simhash.one_of_each(frame(spark, [(1, "one text", "en", "a")] * 3 + [(2, "One text", "en", "a"), (3, "other", "en", "b")]))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_templates_with_variable_fields(spark):
    rows = []
    for i in range(12):
        own = "\n".join(f"sentence of its own {chr(97 + i)}{chr(97 + j)} with more words {'x' * (i + j + 1)}" for j in range(6))
        rows.append((i, f"{own}\nServed page {i} of the archive by host{i}\nWritten by the kind author {'abcdefghijkl'[i] * 5} of this very journal here", "en", "a"))
    got = linededup.cleaned(frame(spark, rows)).toPandas()
    assert not got.text.str.contains("Served page").any()
    assert not got.text.str.contains("kind author").any()
    assert (got.n_dropped == 2).all() and got.text.str.count("sentence of its own").eq(6).all()


def test_copies_keep_their_lines(spark):
    """Equal texts, and near copies with a word changed in one line or in every line, in pairs and in large groups."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = [(i, "a first line of some length\na second line of some length", "en", "a") for i in range(10)]
    for size, changes in ((40, 1), (2, 1), (2, 1), (2, 1), (60, 5), (2, 5), (2, 5)):
        base = [[word() for _ in range(30)] for _ in range(5)]
        for _ in range(size):
            text = [list(line) for line in base]
            for line in rng.sample(range(5), changes):
                text[line][rng.randrange(30)] = word()
            rows.append((100 + len(rows), "\n".join(map(" ".join, text)), "en", "a"))
    got = linededup.cleaned(frame(spark, rows)).toPandas().set_index("doc_id")
    assert (got.n_dropped == 0).all() and all(got.text[i] == t for i, t, *_ in rows)


@pytest.mark.parametrize("n_docs, n_words, own, drops", [(5, 60, 6, True), (30, 60, 1, True), (2, 25, 6, True), (5, 10, 6, False), (8, 10, 6, True)])
def test_shared_lines_go(spark, n_docs, n_words, own, drops):
    """One line in otherwise different texts goes: a long one from two texts on, a short one from six."""
    rng = random.Random(n_docs)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    shared = line(n_words)
    rows = [(i, "\n".join([*(line(12) for _ in range(own)), shared]), "en", "a") for i in range(n_docs)]
    got = linededup.cleaned(frame(spark, rows)).toPandas()
    assert got.n_dropped.eq(int(drops)).all() and got.text.str.contains(shared).eq(not drops).all()


def test_templates_brute_force(spark):
    """Lines that agree but for one fifth of their words are one template, whatever else has their length and first words."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    own = lambda: "\n".join(" ".join(word() for _ in range(12)) for _ in range(8))
    known = [word() for _ in range(9)]
    rows, want = [], {}
    for i in range(120):
        line = list(known)
        kind = i % 4
        # 0: one variable word; 1: two beside each other in one fifth; 2: two far apart, all different; 3: other words.
        if kind == 0:
            line[4] = word()
        elif kind == 1:
            line[7], line[8] = word(), word()
        elif kind == 2:
            line[3], line[6] = word(), word()
        else:
            line[3:] = [word() for _ in range(6)]
        rows.append((i, own() + "\n" + " ".join(line), "en", "a"))
        want[i] = line

    def parts(line):
        edges = [len(line) * k // 5 for k in range(6)]
        return {(k, tuple(line[: edges[k]]), tuple(line[edges[k + 1] :])) for k in range(5)}

    from collections import Counter

    counts = Counter(p for line in want.values() for p in parts(line))
    got = linededup.cleaned(frame(spark, rows)).toPandas().set_index("doc_id")
    assert {i for i in want if got.n_dropped[i]} == {i for i, line in want.items() if any(counts[p] >= 6 for p in parts(line))}
    assert {i % 4 for i in want if got.n_dropped[i]} == {0, 1} and got.n_dropped.max() == 1


def test_maximal_segments_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        values = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randrange(1, 14))]
        total = np.concatenate([[0], np.cumsum(values)])
        hits = [i for i, v in enumerate(values) if v > 0]
        got = [(hits[a], hits[b]) for a, b in toxicity.segments([float(total[i]) for i in hits], [float(total[i + 1]) for i in hits])]

        def split(lo, hi):
            """The segment of largest score (of equal ones the shortest, leftmost) and those of both rests."""
            best = max(((total[j + 1] - total[i], -(j - i), -i) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return split(lo, i) + [(i, j)] + split(j + 1, hi)

        want = split(0, len(values))
        assert sum(total[j + 1] - total[i] for i, j in got) == sum(total[j + 1] - total[i] for i, j in want)
        # Without ties the segments are the same ones.
        values = [v + rng.random() / 100 for v in values]
        total = np.concatenate([[0], np.cumsum(values)])
        hits = [i for i, v in enumerate(values) if v > 0]
        got = [(hits[a], hits[b]) for a, b in toxicity.segments([float(total[i]) for i in hits], [float(total[i + 1]) for i in hits])]
        assert got == split(0, len(values))


def test_toxic_scores_brute_force(spark):
    """Odds, segments, E-values and their sums, recomputed from the model's parameters."""
    import math
    import re

    rng = random.Random(6)
    plain, telling = [f"{a}{b}" for a in ("wort", "haus", "baum", "feld") for b in ("ung", "heit", "lich", "keit")], ["achlichung", "achlichkeit", "scum"]
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(plain, k=40)
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(30)
            words[at : at + 3] = rng.choices(telling, k=3)
        rows.append((i, " ".join(words), "de", "a"))
        labels.append((i, 1, int(toxic)))
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.learn(docs, labels)
    assert model.odds["achli*"] > 1 and model.odds["scum"] > 1 and model.odds["worth*"] < 0.5
    got = model.apply(docs.select("doc_id", "text")).toPandas().set_index("doc_id")
    for i, text, *_ in rows:
        scores = [toxicity.token_score(t, model.odds) for t in re.findall(r"[^\W\d_]+", text)]
        best, total = -math.log(model.k * len(scores)), 0.0
        for a in range(len(scores)):
            for b in range(a, len(scores)):
                best = max(best, -math.log(max(model.k * len(scores) * math.exp(-model.decay * sum(scores[a : b + 1])), 1e-300)))
        for p in got.passages[i]:
            assert p["score"] == pytest.approx(sum(scores[p["first"] : p["last"] + 1]))
            assert p["e_value"] == pytest.approx(model.k * len(scores) * math.exp(-model.decay * p["score"])) and p["e_value"] <= toxicity.SIGNIFICANT
            total -= math.log(p["e_value"])
        assert got.best[i] == pytest.approx(best)
        assert got.total[i] == pytest.approx(total)
    flags = toxicity.scored(docs, labels).toPandas()
    held = flags[flags.held_out]
    assert (held.predicted == (held.doc_id % 5 == 0)).all() and len(held) > 40


def test_packing_of_many_sizes():
    rng = np.random.default_rng(2)
    packer = packing.Packer(0, capacity=64)
    given = {}
    for d in range(500):
        ids = rng.integers(0, 1000, rng.choice([1, 5, 33, 40, 63, 64, 65, 300])).astype(np.uint32)
        given[d] = len(ids)
        packer.add(d, ids)
    # Before the end only full pieces and windows filled by the level array are closed.
    assert packer.filled > 0 and packer.next_sequence == packer.filled + sum(n // 64 for n in given.values())
    packer.finish()
    lengths = {}
    for doc_id, start, length, _, total, sequence, offset in sorted(packer.done, key=lambda r: (r[5], r[6])):
        assert offset == lengths.get(sequence, 0) and total == given[doc_id] and start + length <= total
        lengths[sequence] = offset + length
    assert sum(lengths.values()) == sum(given.values())
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())


@pytest.mark.parametrize("kind, name", [(tokens.LowerWords, "word_bpe_49k.json"), (tokens.SpacedText, "byte_bpe_50k.json")])
def test_ids_equal_the_tokenizer(kind, name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = kind(public_tokenizers.path(name))
    rng = random.Random(9)
    alphabet = ["a", "Z", "é", "é", "ß", "İ", "'s", "'LL", ".", ",", ".,", "9", " ", "  ", "\n", "\t", "\xa0", "\u2009", "\x1c", "\x85", "日本", "<|endoftext|>", "<|x", "😀", "퟿", "ǅ", "Σ", "\x00", "×", "À"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choices(alphabet[:6] + alphabet[8:15], k=rng.randrange(0, 30))) for _ in range(3000)]
    for batch in ([t for t in texts if "<|" not in t], texts, []):
        ids, ends = encoder.encode(pa.array(batch, pa.string()))
        assert len(ends) == len(batch) + 1 and ends[-1] == len(ids)
        want = encoder.pieces.tokenizer.encode_batch(batch, add_special_tokens=False)
        for text, a, b, own in zip(batch, ends[:-1], ends[1:], want, strict=True):
            assert ids[a:b].tolist() == own.ids, repr(text)


def best_fit_windows(lengths, capacity):
    """Windows of best fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_equals_best_fit_of_documents():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([16, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 200))]
        if rng.random() < 0.3:
            lengths += [rng.randint(1, capacity)] * 500
        counts = {n: lengths.count(n) for n in set(lengths)}
        steps = bestfit.plan(counts, capacity)
        windows = {}
        for n in counts:
            own = sorted(s for s in steps if s[0] == n)
            for rank in range(counts[n]):
                _, first, each, window, offset = [s for s in own if s[1] <= rank][-1]
                windows.setdefault(window + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
        for pieces in windows.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(windows) == best_fit_windows(lengths, capacity)


def test_fenwick_cuts():
    rng = random.Random(2)
    texts = ["", "\n", "\n\n\n", "no line feed", "é" * 700, "x\n" * 900] + ["".join(rng.choices("aé😀\n", k=rng.randrange(0, 400))) for _ in range(60)]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    for block in (1, 3, 64, 512):
        forest = middle.Forest(np.frombuffer(b"".join(data), np.uint8), offsets, block)
        for i, text in enumerate(texts):
            lines = text.splitlines(keepends=True) if "\n" in text else [text] * bool(text)
            assert forest.n[i] == len(lines)
            for units in range(len(lines) + 1):
                start = "".join(lines[:units])
                assert forest.cut(i, units) == (len(start.encode()), len(start))


def test_middle_forms(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(["a\nb\nc", "has <S> in it", "<P", "P>x\n<", "", "x\n" * 3000] * 8)]
    got = middle.transform(frame(spark, rows)).withColumn("back", middle.restored(F.col("output"), F.col("form"))).toPandas().set_index("doc_id")
    for i, t, *_ in rows:
        assert got.back[i] == t and (got.form[i] == "plain") == (t == "" or "<S>" in t)
        if got.form[i] != "plain":
            p, m = int(got.prefix_chars[i]), int(got.middle_chars[i])
            parts = t[:p], t[p : p + m], t[p + m :]
            assert got.output[i] == ("<P>{0}<S>{2}<M>{1}" if got.form[i] == "psm" else "<S>{2}<P>{0}<M>{1}").format(*parts)
    assert {"psm", "spm"} <= set(got.form)


def test_perfect_hash_is_minimal():
    names = [f"term{i}" for i in range(5000)] + ["é", "日本"]
    shard = divergence.Shard(names)
    assert sorted(shard.names) == sorted(names) and shard.unparted == 0
    lookup = divergence.Lookup(1, [(0, 10, shard.words.tobytes(), shard.sizes, " ".join(shard.names), shard.unparted)])
    slots = lookup.slots(pa.array([*shard.names, "other", "term5001"]))
    assert slots.tolist() == [*range(10, 10 + len(names)), -1, -1]
    # Terms that no level could part are found by name.
    named = divergence.Lookup(1, [(0, 0, b"", [], " ".join(sorted(names)), len(names))])
    assert named.slots(pa.array(["é", "nothing"])).tolist() == [sorted(names).index("é"), -1]


def test_divergence_brute_force(spark):
    """Several shards, blocks, and a source and a language without terms; exact integers throughout."""
    import re
    from collections import Counter

    rng = random.Random(5)
    rows = []
    for i in range(150):
        text = " ".join(rng.choices([f"w{c}" if c != "c" else "É" + c for c in "abcdefghijklmn"], k=rng.randrange(0, 12)))
        rows.append((i, text if i % 11 else None, ["en", "de", None][i % 3], [None, "x", "y", "z"][i % 4]))
    rows += [(900, "5 5 5", "en", "empty"), (901, None, "xx", "a"), (902, None, "xx", "b"), (903, "W W", "one", "a")]
    groups, texts = {}, {}
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.setdefault((lang or "", source or ""), Counter()).update(found)
        texts.setdefault(lang or "", Counter()).update(set(found))
    want = set()
    for lang, of in texts.items():
        kept = sorted(t for t, n in of.items() if n >= 10)
        sources = sorted(s for k, s in groups if k == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(groups[lang, s]) for s in sources}
        q = share(sum((groups[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t])[:10]
            want |= {(lang, s, "pair", o, -v, r) for r, (v, o) in enumerate(pairs, 1)}
            want |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(terms, 1)}
    for options in ({}, {"shard_terms": 2, "cells": 6}):
        got = divergence.audit(frame(spark, rows).repartition(5), **options).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_personal_data_that_touches():
    one = "mail ab.c@mail1.example.com today"
    samples = ["+1 (988) 555-2485", "4539578763621486", "10.20.30.40", "ab.c@mail1.example.com", "+1 (456) 555-2186", "4716108999716531", "99.1.2.3", "12 2019", "555 1234 5678"]
    weights = pii.fit(pii.examples(samples * 4))
    text = "call +1 (269) 555-3296 4539578763621486 or"
    assert pii.base_spans(text) == []
    assert [(text[a:b], k) for a, b, k in pii.added_spans(text, [], weights)] == [("+1 (269) 555-3296", "phone"), ("4539578763621486", "card")]
    assert pii.added_spans(one, pii.base_spans(one), weights) == []
    assert pii.added_spans("in 2019 1234 5678 9012 were", [], weights) == []
    assert pii.base_spans("9" * 5000 + ".1.1.1") == [] and len(pii.base_spans("a@b.c@d.e")) == 1


VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType()), StructField("copies", StringType())])


def brute_links(rows, threshold=0.98, kind=np.float32):
    n = len(rows)
    unit = []
    for _, v, label, *_ in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, dtype=kind).astype(float) if ok else None
        unit.append(a / np.sqrt(a @ a) if ok else None)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    component = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([component[i], *(component[j] for j in near[i])])
            changed |= low != component[i]
            component[i] = low
    return [(r[0], len(k), rows[c][0], rows[c][0] == r[0]) for r, k, c in zip(rows, near, component, strict=True)]


@pytest.mark.parametrize("shard", [40, 10_000])
def test_embeddings(spark, shard):
    rng = np.random.default_rng(4)
    rows, number = [], 0
    for family in range(30):
        centre = rng.normal(size=16)
        for _ in range(1 + family % 9):
            rows.append((number, (centre + 0.04 * rng.normal(size=16)).tolist(), family % 3, "x"))
            number += 1
    rows += [(number + i, rows[5][1], rows[5][2], "x") for i in range(30)]
    number += 30
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(number + i, v, 0, "x") for i, v in enumerate(bad)] + [(number + 9, rows[0][1], None, "x")]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, VECTORS), shard_size=shard).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(brute_links(rows))
    assert hnsw.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_graph_works_in_batches(monkeypatch):
    """Links of all vectors, found from their own place and from the entry, without a Python step per vector."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 32))
    spread = [centres[i] + 0.02 * rng.normal(size=32) for i in range(300) for _ in range(1 + i % 5)] + [centres[0] + 0.01 * rng.normal(size=32) for _ in range(400)]
    unit = np.array(spread) / np.linalg.norm(spread, axis=1, keepdims=True)
    unit = unit[rng.permutation(len(unit))]
    calls = {"insert": 0, "within": 0}
    for name in ("insert", "within"):
        run = getattr(hnsw.Graph, name)
        monkeypatch.setattr(hnsw.Graph, name, lambda self, *a, _run=run, _name=name: (calls.update({_name: calls[_name] + 1}), _run(self, *a))[1])
    built = hnsw.Graph.build(unit)
    graph = hnsw.Graph.loads(unit, built.dumps())
    assert all((a == b).all() for a, b in zip(graph.links, built.links, strict=True)) and len(graph.links) > 1
    for links in graph.links:
        for i, row in enumerate(links.tolist()):
            ends = [j for j in row if j >= 0]
            assert len(ends) == len(set(ends)) and i not in ends
    near = unit @ unit.T >= 0.98
    got = list(hnsw.answer(graph, unit, 0.98, np.full(len(unit), -1)))
    assert all(near[i, h].all() and len(h) == len(set(h.tolist())) for i, h in enumerate(got)) and sum(map(len, got)) >= 0.99 * near.sum()
    np.fill_diagonal(near, False)
    got = list(hnsw.answer(graph, unit, 0.98, np.arange(len(unit))))
    assert all(near[i, h].all() for i, h in enumerate(got)) and sum(map(len, got)) >= 0.999 * near.sum()
    assert calls["insert"] < len(unit) / 50 and calls["within"] < len(unit) / 20
    for n in (1, 2, 3, 65):
        small = hnsw.Graph.loads(unit[:n], hnsw.Graph.build(unit[:n]).dumps())
        near = unit[:n] @ unit[:n].T >= 0.98
        assert [h.tolist() for h in hnsw.answer(small, unit[:n], 0.98, np.full(n, -1))] == [np.flatnonzero(r).tolist() for r in near]


def families(rng, size=32):
    spread = [c + 0.01 * rng.normal(size=size) for i, c in enumerate(rng.normal(size=(300, size))) for _ in range(1 + i % 7)]
    unit = np.array(spread) / np.linalg.norm(spread, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    return unit, near


def asked_widths(monkeypatch):
    widths = []
    run = hnsw.Graph.within
    monkeypatch.setattr(hnsw.Graph, "within", lambda self, queries, own, threshold, width: (widths.append(width), run(self, queries, own, threshold, width))[1])
    return widths


def test_graph_finds_families_that_greedy_steps_miss(monkeypatch):
    """A batch that is inserted far from its families still gets links to them, and a query that starts there still meets them."""
    unit, near = families(np.random.default_rng(5))
    monkeypatch.setattr(hnsw, "BEAM_BUILD", 1)
    graph = hnsw.Graph.build(unit[np.argsort(np.arange(len(unit)) % 7, kind="stable")])
    near = near[np.ix_(*[np.argsort(np.arange(len(unit)) % 7, kind="stable")] * 2)]
    widths = asked_widths(monkeypatch)
    got = list(hnsw.answer(graph, graph.vectors, 0.98, np.arange(len(unit))))
    assert [h.tolist() for h in got] == [np.flatnonzero(r).tolist() for r in near]
    assert max(widths) == hnsw.BEAM


def test_graph_without_links_to_a_vector():
    """A vector that has links, but that no vector has a link to, is found from the ends of its links."""
    unit, near = families(np.random.default_rng(6))
    graph = hnsw.Graph.build(unit)
    lost = np.flatnonzero(near.sum(axis=1) >= 4)[::5]
    for links in graph.links:
        links[np.isin(links, lost)] = -1
    graph.doors[:] = -1
    # Own places of the others only: those of the lost ones would be known.
    asking = np.setdiff1d(np.arange(len(unit)), lost)
    got = graph.within(unit[asking], asking, 0.98, 24)
    assert [np.setdiff1d(h, [i]).tolist() for h, i in zip(got, asking.tolist(), strict=True)] == [np.flatnonzero(near[i]).tolist() for i in asking]


def test_graph_that_fails_the_audit(monkeypatch):
    """Wider beams can't mend a graph without links; the block is compared with all after few of them."""
    unit, near = families(np.random.default_rng(7))
    graph = hnsw.Graph.build(unit)
    for links in graph.links:
        links[:] = -1
    graph.doors[:] = -1
    widths = asked_widths(monkeypatch)
    got = list(hnsw.answer(graph, unit, 0.98, np.arange(len(unit))))
    assert [h.tolist() for h in got] == [np.flatnonzero(r).tolist() for r in near]
    assert max(widths) <= hnsw.WIDEST


def test_two_shards_meet_once():
    """Links between a shard and the queries of another count for both ends, with the copies of the other end."""
    unit, near = families(np.random.default_rng(8))
    frame = pd.DataFrame({"node": [f"n{i:04}" for i in range(len(unit))], "copies": 1 + np.arange(len(unit)) % 3, "embedding": list(unit)})
    here, there = frame[::2], frame[1::2]
    got = hnsw._ask(0.98)((0, 32, 1, 0), hnsw._build((0, 32, 1), here), there)
    counts = got[got.other.isna()].groupby("node").found.sum()
    between = near.copy()
    between[::2, ::2] = between[1::2, 1::2] = False
    want = between @ frame.copies.to_numpy()
    assert [counts.get(n, 0) for n in frame.node] == want.tolist()


def test_embeddings_in_double_precision(spark):
    """Components that no float can hold, and differences that a float does not see."""
    schema = "vec_id long, embedding array<double>, label int"
    near = [1.0, 0.2030586]  # cosine with (1, 0): 0.980000...
    rows = [(1, [1e39, 0.0], 0), (2, [3e39, 0.0], 0), (3, [0.0, 1e-60], 0), (4, [0.0, 2e-60], 0), (5, [1.0, 0.0], 1), (6, near, 1), (7, [1.0, 0.2030588], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    want = {r[0]: (n, c) for r, (_, n, c, _) in zip(rows, brute_links([(*r, "x") for r in rows], kind=np.float64), strict=True)}
    assert got == want and want[1] == (1, 1) and want[3] == (1, 3)


def test_mixing_limits(spark):
    rows = [(i, "word " * (i % 7), None, None if i % 5 == 0 else "abc"[i % 3]) for i in range(400)] + [(1000 + i, None, None, "wordless") for i in range(5)]
    got = mixing.taken_words(frame(spark, rows)).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    assert got.taken.sum() == int(1.5 * got["size"].sum())
    for _, s in got.groupby("source_size"):
        assert abs(s.taken.sum() - s.target.iloc[0]) <= 12 or s.source_size.iloc[0] == 0
    again = mixing.taken_words(frame(spark, rows).repartition(7)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_statistics_of_repeated_windows(spark):
    from clozeframe.llm.statistics import with_statistics
    from test_queries import base_statistics

    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcd", k=rng.randrange(0, 60))) for _ in range(200)] + ["a a a", "a a a a", "x\ny\nx\n \n \nx", None, "", LONG]
    got = with_statistics(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]).select("doc_id", "text", F.lit(1).alias("_words"))).select("doc_id", "stats.*").toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        assert got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].tolist() == base_statistics(t)


@pytest.mark.parametrize("kind", ["lines", "words"])
def test_repetition_under_the_base_limit_is_an_outlier(spark, kind):
    rng = random.Random(12)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(10))
    rows = [(i, "\n".join(line() for _ in range(20)), "en", "a") for i in range(300)]
    own, again = [line() for _ in range(11)], line()
    rows.append((900, "\n".join(own + [again] * 9) if kind == "lines" else "\n".join([*own, " ".join([again] * 9)]), "en", "a"))
    got = outliers.quality_rules(frame(spark, rows)).toPandas().set_index("doc_id")
    assert not got.base_failed.any() and got.n_repeat_words[900] == 90 and (got.n_dup_lines[900] > 0) == (kind == "lines")
    assert not got.kept[900] and got.kept.drop(900).all()
