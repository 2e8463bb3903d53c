"""Toxicity by maximum-scoring segments.

The units are words and their beginnings of four to eight letters.  Their scores are log-odds between toxic and clean documents with
an informative Dirichlet prior: ``PRIOR`` pseudo-counts, shared out by the pooled frequencies, pull the odds of rare units to zero.  A token
scores what the unit with the strongest odds says, less a constant drift, so clean text falls.  In each text one linear scan finds
all maximal segments.  A segment of score S in a text of n tokens has E-value K n exp(-lambda S): lambda is the rate at which
the mean of exp(lambda score) over tokens of clean documents is one, K is fitted to the best segments of clean documents (an extreme-value
distribution), and both on labelled documents that did not set the scores.  Log E-values of the best segment and of all significant ones
are turned into a chance by a logistic model, fitted on those documents too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import bind, flat_words, giving_back, hash_sample, held_out, kept, slices

# Labelled documents learnt from at most, in the order of a hash of their ids.
SAMPLE = 20_000
# Units with a score of their own at most, those with the strongest odds.
UNITS = 50_000
# Pseudo-counts of a unit; lengths of the beginnings of words; what each token loses.
PRIOR = 20.0
BEGINNINGS = (4, 5, 6, 7, 8)
DRIFT = 0.5
# Remainder of crc32 modulo 4 of the documents that calibrate.
CALIBRATING = 3
SIGNIFICANT = 0.05
THRESHOLD = 0.3
LETTERS = r"[^\p{L}\p{M}]+"

SCORED = "n_tokens bigint, passages array<struct<first:int,last:int,score:double,e_value:double>>, best double, total double"


def letters(texts: pa.Array) -> pa.Array:
    """Texts in lower case with one blank for all that is no letter."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), LETTERS, " ")


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case runs of letters of a slice of texts, and the offsets of each text's."""
    return flat_words(letters(texts))


def units(token: str) -> list[str]:
    """The token and its proper beginnings (which end in an asterisk)."""
    return [token, *[token[:k] + "*" for k in BEGINNINGS if len(token) > k]]


def segments(lefts: list[float], rights: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments, as (first, last) indices of positive items.

    ``lefts`` and ``rights`` are the running totals before and after each item with a positive score.
    """
    found: list[tuple[int, int, float, float]] = []
    for k, (left, right) in enumerate(zip(lefts, rights, strict=True)):
        first = k
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((first, k, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


def counts(labelled: DataFrame) -> DataFrame:
    """unit, toxic, clean: in how many different surroundings (two tokens on each side) a unit's tokens occur in each class of (text, y).

    Copies of a text, and the unchanged parts of near copies, repeat their surroundings, so a family of copies counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("y"), letters(part.column("text"))], ["y", "text"])

    plain = labelled.select(F.col("y").cast("long"), "text").mapInArrow(giving_back(run), "y bigint, text string")
    around = bind(
        F.filter(F.split("text", " "), lambda t: t != ""),
        lambda w: F.transform(
            w,
            lambda t, i: F.struct(t.alias("token"), F.xxhash64(*[F.coalesce(F.get(w, i + d), F.lit("")) for d in (-2, -1, 1, 2)]).alias("around")),
        ),
    )
    places = plain.select("y", F.explode(around).alias("p")).select("y", "p.*").distinct()
    of_token = places.groupBy("token").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    beginnings = [F.when(F.length("token") > k, F.concat(F.substring("token", 1, k), F.lit("*"))) for k in BEGINNINGS]
    each = of_token.select(F.explode(F.array_compact(F.array("token", *beginnings))).alias("unit"), "toxic", "clean")
    return each.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def unit_odds(labelled: DataFrame, limit: int = UNITS) -> dict[str, float]:
    """Shrunken log-odds of at most ``limit`` units."""
    table = kept(counts(labelled))
    n1, n0 = (float(x or 0) for x in table.where(~F.col("unit").endswith("*")).agg(F.sum("toxic"), F.sum("clean")).first())
    if not n1 or not n0:
        return {}
    share = n1 / (n1 + n0)
    odds = F.log((F.col("toxic") + PRIOR * share) / (F.col("clean") + PRIOR * (1 - share))) - math.log(share / (1 - share))
    rows = table.select("unit", odds.alias("odds")).orderBy(F.abs("odds").desc(), "unit").limit(limit).collect()
    return {r["unit"]: r["odds"] for r in rows}


def token_score(token: str, odds: dict[str, float]) -> float:
    """The strongest odds among the token's units, less the drift."""
    return max((odds.get(u, 0.0) for u in units(token)), key=abs) - DRIFT


def decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda at which the weighted mean of exp(lambda score) is one."""
    mean = lambda x: float((weights * np.exp(x * scores)).sum() / weights.sum()) - 1
    low, high = 0.05, 5.0
    if not weights.sum() or mean(low) >= 0:
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 0 else (low, middle)
    return low


def score_histogram(docs: DataFrame, odds: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Token scores in hundredths, and how many tokens of ``docs`` have each."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                coded = tokens(part.column("text"))[0].dictionary_encode()
                own = [round(100 * token_score(w, shared.value)) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
                values, n = np.unique(np.array(own, dtype=np.int64)[coded.indices.to_numpy()], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["score", "n"])

    rows = docs.select("text").mapInArrow(giving_back(run), "score bigint, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()
    return np.array([r["score"] / 100 for r in rows], dtype=np.float64), np.array([r["n"] for r in rows], dtype=np.float64)


def segment_scores(docs: DataFrame, odds: dict[str, float], decay_rate: float, k: float, keep: bool = False) -> DataFrame:
    """``docs`` (with a column ``text``, which only ``keep`` passes on) and columns n_tokens, passages (significant), best, total.

    best and total are minus the log E-values of the best segment (of score 0 if there is none) and summed over significant ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep or f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                words, offsets = tokens(part.column("text"))
                coded = words.dictionary_encode()
                own = [token_score(w, shared.value) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
                value = np.array(own, dtype=np.float64)[coded.indices.to_numpy()]
                after = np.cumsum(value)
                hits = np.flatnonzero(value > 0)
                sizes = np.diff(offsets)
                # Without a segment the best score is 0.
                best, total = -np.log(k * np.maximum(sizes, 1)), np.zeros(len(sizes))
                passages: list[list] = [[] for _ in sizes]
                bounds = np.searchsorted(hits, offsets)
                for i in np.flatnonzero(np.diff(bounds)):
                    at = hits[bounds[i] : bounds[i + 1]]
                    left, right = after[at] - value[at], after[at]
                    for a, b in segments(left.tolist(), right.tolist()):
                        s = float(right[b] - left[a])
                        e = k * sizes[i] * math.exp(-decay_rate * s)
                        best[i] = max(best[i], -math.log(max(e, 1e-300)))
                        if e <= SIGNIFICANT:
                            total[i] -= math.log(max(e, 1e-300))
                            passages[i].append({"first": int(at[a] - offsets[i]), "last": int(at[b] - offsets[i]), "score": s, "e_value": e})
                passed = [c for c in names if keep or c != "text"]
                arrays = [part.column(c) for c in passed]
                arrays += [pa.array(sizes, pa.int64()), pa.array(passages, kind), pa.array(best), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, passed + ["n_tokens", "passages", "best", "total"])

    return docs.mapInArrow(giving_back(run), ", ".join(x for x in (schema, SCORED) if x))


def _evidence() -> list:
    return [F.col("best"), F.sqrt(F.greatest(F.col("total"), F.lit(0.0))), F.log1p("n_tokens")]


class Model:
    """Odds of units, the extreme-value parameters and the logistic calibration."""

    def __init__(self, odds: dict[str, float], decay_rate: float, k: float, weights: list[float], bias: float):
        self.odds, self.decay, self.k, self.weights, self.bias = odds, decay_rate, k, weights, bias

    def apply(self, docs: DataFrame, keep: bool = False) -> DataFrame:
        """``docs`` (without text unless ``keep``), with n_tokens, passages, best, total and the chance ``score``."""
        total = F.lit(self.bias)
        for w, x in zip(self.weights, _evidence(), strict=True):
            total = total + F.lit(w) * x
        return segment_scores(docs, self.odds, self.decay, self.k, keep).withColumn("score", 1.0 / (1.0 + F.exp(-total)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents whose crc32 does not leave 2 modulo 4: those that leave 3 calibrate, the others set the scores.

    Of several labels of an id the largest counts; equal texts count once.  If either part lacks a class, both use all
    of them; without both labels every text gets the share of label 1.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    chosen = hash_sample(rows.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id", sample)
    # At most ``sample`` ids: a bounded broadcast.
    labelled = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(kept(chosen)), "doc_id")
    first = labelled.groupBy(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).agg(F.min("doc_id").alias("doc_id"))
    # The texts of the sample, written once and read by every step below.
    labelled = kept(labelled.join(F.broadcast(kept(first.select("doc_id").distinct())), "doc_id").withColumn("cal", held_out(F.col("doc_id"), 4, CALIBRATING)))
    classes = {(r["cal"], r["y"]) for r in labelled.select("cal", "y").distinct().collect()}
    split = len(classes) == 4
    fitting, calibrating = (labelled.where("not cal"), labelled.where("cal")) if split else (labelled, labelled)
    odds = unit_odds(fitting)
    rate = decay(*score_histogram(calibrating.where("y = 0"), odds))
    found = kept(segment_scores(calibrating, odds, rate, 1.0))
    # The most likely K for this lambda: n documents over the sum of n_tokens exp(-lambda S), from their E-values at K = 1.
    clean = found.where("y = 0 and n_tokens > 0").agg(F.count("*"), F.sum(F.exp(-F.col("best")))).first()
    k = min(max(clean[0] / clean[1], 1e-12), 1.0) if clean[0] else 1.0
    # With K the E-values of all segments fall, so the passages are found again.
    found = segment_scores(calibrating, odds, rate, k)
    rows = kept(found.select(array_to_vector(F.array(*_evidence())).alias("features"), F.col("y").cast("double").alias("label")))
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        rate_ = ((ones or 0) + 0.5) / (n + 1)
        return Model(odds, rate, k, [0.0, 0.0, 0.0], math.log(rate_ / (1 - rate_)))
    fitted = LogisticRegression(regParam=1e-4, maxIter=100).fit(rows)
    return Model(odds, rate, k, [float(w) for w in fitted.coefficients], float(fitted.intercept))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document.

    NULL and empty texts have no passage and get the score of an empty text.  Repeated rows are scored alike, other
    columns are ignored, an empty table gives an empty result.
    """
    model = learn(docs, labels)
    rows = model.apply(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, with all their columns."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")
    found = learn(docs, labels).apply(docs.select(row, "text"), keep=True).where(F.col("score") < threshold)
    return found.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
