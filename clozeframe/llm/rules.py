"""Quality classifier: a sparse ensemble of rules.

Small trees are grown on text statistics of a bounded sample of labelled documents.  Every path from a root to an inner node or
leaf is a conjunction of comparisons, a rule.  A logistic model with a lasso penalty over all rules keeps few
of them.  The kept rules and weights are compiled into one column expression, so every document is scored by Spark without Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import hash_sample, held_out, kept
from clozeframe.llm.statistics import with_statistics

# At most this many labelled documents, in the order of a hash of their ids, are learnt from.
SAMPLE = 20_000
TREES, DEPTH = 12, 3
PENALTY = 0.002
THRESHOLD = 0.7

FEATURES = [
    "log_words", "word_length", "symbol_share", "repeated_lines", "repeated_words", "distinct_share",
    "capital_share", "digit_share", "stop_share", "comma_share", "longest_word", "line_length",
]


def features() -> list[Column]:
    s = lambda name: F.col(f"stats.{name}").cast("double")
    share = lambda a, b: s(a) / F.greatest(s(b), F.lit(1.0))
    return [
        F.log1p(s("n_words")),
        share("word_chars", "n_words"),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_distinct", "n_words"),
        share("n_capitals", "word_chars"),
        share("n_digits", "word_chars"),
        share("n_stops", "n_words"),
        share("n_commas", "n_words"),
        F.log1p(s("longest_word")),
        F.log1p(share("n_words", "n_lines")),
    ]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, whether above, bound)."""

    parts: frozenset[tuple[int, bool, float]]

    def holds(self, x: str) -> Column:
        out = F.lit(True)
        for feature, above, bound in sorted(self.parts):
            value = F.get(x, F.lit(feature))
            out = out & ((value > bound) if above else (value <= bound))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {b:.6g}" for f, above, b in sorted(self.parts))


def paths(forest: str) -> list[Rule]:
    """Every conjunction met on the way down the trees of a forest's description, without repeats."""
    rules: dict[Rule, None] = {}
    stack: list[tuple[int, tuple[int, bool, float]]] = []
    for line in forest.splitlines():
        if "Tree " in line:
            stack = []
        test = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.0-9eE]+)\)", line)
        if test:
            depth = len(test[1])
            stack = [s for s in stack if s[0] < depth] + [(depth, (int(test[2]), test[3] == ">", float(test[4])))]
            rules[Rule(frozenset(part for _, part in stack))] = None
    return list(rules)


@dataclass(frozen=True)
class Ensemble:
    bias: float
    weights: list[tuple[Rule, float]]

    def score(self, x: str = "x") -> Column:
        """Chance of label 1 for an array column of features."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule.holds(x), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 17) -> Ensemble:
    """Learn from rows (x array<double>, y); the share of label 1 where one label is missing or there is no row."""
    rows = kept(labelled.select(array_to_vector("x").alias("features"), "x", F.col("y").cast("double").alias("label")))
    count, ones = rows.agg(F.count("*"), F.sum("label")).first()
    rate = ((ones or 0.0) + 0.5) / (count + 1.0)
    constant = Ensemble(math.log(rate / (1 - rate)), [])
    if not count or ones in (0, count):
        return constant
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5, maxBins=64, featureSubsetStrategy="onethird"
    ).fit(rows)
    rules = paths(forest.toDebugString)
    if not rules:
        return constant
    holds = F.array(*[rule.holds("x").cast("double") for rule in rules])
    model = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=100, standardization=False).fit(
        rows.select(array_to_vector(holds).alias("features"), "label")
    )
    found = [(rule, float(w)) for rule, w in zip(rules, model.coefficients.toArray(), strict=True) if w]
    return Ensemble(float(model.intercept), found)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from at most ``sample`` documents with a label whose crc32 does not leave 2 modulo 4; of several labels of an id the
    largest counts, NULL labels are none.  NULL and empty texts are scored as empty ones.  Repeated rows are scored alike,
    other columns are ignored, an empty table gives an empty result.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    chosen = hash_sample(known.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id", sample)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    # At most ``sample`` ids: a bounded broadcast.
    learnt = docs.join(F.broadcast(kept(chosen)), "doc_id")
    model = fit(with_statistics(learnt, wide=True).select(F.array(*features()).alias("x"), "y"))
    rows = with_statistics(docs, wide=True).select("doc_id", F.array(*features()).alias("x"))
    score = model.score()
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
