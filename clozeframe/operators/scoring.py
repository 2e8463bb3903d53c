"""Batch scoring by a user-supplied model, and metrics of sparse scores in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clozeframe.functions.measures import ratio
from clozeframe.operators.joins import join_on_group
from clozeframe.session import computed_once

# Fixed value: contexts per model call.
BATCH_SIZE = 30


class Scorer(Protocol):
    """A model as the scoring operator sees it."""

    def __call__(self, contexts: list[str], mask_positions: np.ndarray) -> np.ndarray:
        """Scores over the vocabulary at the mask, one row per context."""

    def index_of(self, words: list[str]) -> np.ndarray:
        """Vocabulary positions of words."""

    def word_at(self, indices: np.ndarray) -> list[str]:
        """Words at vocabulary positions."""


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score(
    df: DataFrame,
    load_scorer: Callable[[], Scorer],
    words: list[str],
    context: str = "cloze",
    mask_index: str = "mask_index",
    batch_size: int = BATCH_SIZE,
    renormalised: bool = False,
    dedupe: bool = True,
    tasks: int | None = None,
    salts: int = 1,
    dealt: bool = False,
) -> DataFrame:
    """Adds argmax, maxprob, entropy, and probability and rank of each word column.

    The model is loaded once per task; ``tasks`` (default: the session's shuffle partitions) is kept as given, because the
    work of a task follows from its contexts and not from their bytes.  Rows of one context go to one task, or with
    ``salts`` to that many, and lie together there, so a context is scored once per Arrow batch that holds it.  Score
    vectors are reduced to metrics inside the task and never leave it; memory follows from the batch
    size and the vocabulary, not from the number of words.  With ``dedupe`` equal (context, words) rows are answered once; answers
    meet their rows by a 128-bit hash of the inputs, so a context moves once.  With ``dealt`` the rows already lie as the caller
    wants them scored, and no row moves.
    """
    inputs = [context, mask_index, *words]
    metric_schema = ", ".join(
        ["argmax string, maxprob double, entropy double"]
        + [f"`{w}_probability` double, `{w}_rank` int" for w in words]
    )

    def reduce_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for pdf in frames:
            code = pdf.groupby([context, mask_index], sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.searchsorted(code, np.arange(code[-1] + 1 if len(code) else 0))
            contexts = pdf[context].to_numpy()[order[starts]]
            positions = pdf[mask_index].to_numpy()[order[starts]]
            out = {"argmax": np.empty(len(pdf), dtype=object)}
            out |= {name: np.empty(len(pdf)) for name in ("maxprob", "entropy")}
            for w in words:
                out |= {f"{w}_probability": np.empty(len(pdf)), f"{w}_rank": np.empty(len(pdf), dtype=np.int32)}
            word_values = {w: pdf[w].to_numpy() for w in words}
            for first in range(0, len(contexts), batch_size):
                last = min(first + batch_size, len(contexts))
                p = _softmax(np.asarray(scorer(list(contexts[first:last]), positions[first:last]), dtype=float))
                low, high = np.searchsorted(code, [first, last])
                rows, at = order[low:high], code[low:high] - first
                logs = np.log2(p, out=np.zeros_like(p), where=p > 0.0)
                out["argmax"][rows] = np.array(scorer.word_at(p.argmax(axis=1)), dtype=object)[at]
                out["maxprob"][rows] = p.max(axis=1)[at]
                out["entropy"][rows] = -(p * logs).sum(axis=1)[at]
                target_p = _softmax(p) if renormalised else p
                ascending = np.sort(target_p, axis=1)
                bounds = np.searchsorted(at, np.arange(last - first + 1))
                for w in words:
                    word_p = target_p[at, scorer.index_of(list(word_values[w][rows]))]
                    out[f"{w}_probability"][rows] = word_p
                    rank = np.empty(len(rows), dtype=np.int32)
                    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        rank[a:b] = ascending.shape[1] - np.searchsorted(ascending[k], word_p[a:b], side="right") + 1
                    out[f"{w}_rank"][rows] = rank
            yield pdf[passed].assign(**out)

    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*(words or [context])), F.lit(salts))
    dedupe = dedupe and not dealt
    df = df.withColumn("_id", row_id(inputs)) if dedupe else df
    work = df.select("_id", *inputs) if dedupe else df
    if not dealt:
        work = work.repartition(tasks, context, mask_index, salt)
        # Equal rows are in one task already, so dropping repeats moves nothing.
        work = (work.distinct() if dedupe else work).sortWithinPartitions(context, mask_index)
    passed = ["_id"] if dedupe else work.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields if f.name in passed)
    scored = work.mapInPandas(reduce_batches, f"{fields}, {metric_schema}")
    return df.join(scored, "_id").drop("_id") if dedupe else scored


def row_id(columns: list[str]) -> Column:
    """128-bit hash of the columns, NULL apart from any value."""
    return F.unhex(F.md5(F.concat(*[_id_part(c) for c in columns]).cast("binary")))


def _id_part(c: str) -> Column:
    return F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))


def prime_metrics(
    df: DataFrame, load_scorer: Callable[[], Scorer], store: ScoreStore | None = None, model: str | None = None, **options
) -> DataFrame:
    """Target and related-prime metrics of the same context in one model pass, or from a store for a named model."""
    words = ["target", "related"]
    return score(df, load_scorer, words, **options) if store is None else store.score(df, load_scorer, model, words, **options)


class ScoreStore:
    """Scores that outlive a run: one row per model, context, mask and word, in a table partitioned by model.

    Rows are found by a 128-bit hash of those four.  A run scores only what an anti join finds missing, and adds it to the table in
    one write, so a run that is stopped adds all of its scores or none.
    """

    METRICS = ["argmax", "maxprob", "entropy", "word_probability", "word_rank"]
    SCHEMA = "id string, argmax string, maxprob double, entropy double, word_probability double, word_rank int, model string"

    def __init__(self, path: str):
        self.path = path

    def known(self, spark: SparkSession, model: str) -> DataFrame:
        """Stored scores of a model, one row per id."""
        try:
            table = spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            table = spark.createDataFrame([], self.SCHEMA)
        return table.where(F.col("model") == model).drop("model").dropDuplicates(["id"])

    def score(
        self, df: DataFrame, load_scorer: Callable[[], Scorer], model: str, words: list[str], context: str = "cloze", mask_index: str = "mask_index", **options
    ) -> DataFrame:
        """What the operator ``score`` gives, from the store where it has it."""
        spark = df.sparkSession
        key = lambda w: F.md5(F.concat(F.lit(f"{len(model)}:{model}"), *map(_id_part, (context, mask_index, w))).cast("binary"))
        rows = df.withColumns({f"_id_{w}": key(w) for w in words})
        pairs = F.array(*[F.struct(F.col(f"_id_{w}").alias("id"), F.col(w).alias("word")) for w in words])
        asked = rows.select(context, mask_index, F.explode(pairs).alias("_p")).select(context, mask_index, "_p.*").dropDuplicates(["id"])
        missing = computed_once(asked.join(self.known(spark, model).select("id"), "id", "left_anti"))
        if not missing.isEmpty():
            scored = score(missing, load_scorer, ["word"], context=context, mask_index=mask_index, dedupe=False, **options)
            added = scored.select("id", *self.METRICS).withColumn("model", F.lit(model))
            added.write.mode("append").partitionBy("model").parquet(self.path)
        known = self.known(spark, model)
        out = rows
        for i, w in enumerate(words):
            shared = ["argmax", "maxprob", "entropy"] if i == 0 else []
            found = known.select(F.col("id").alias(f"_id_{w}"), *shared, F.col("word_probability").alias(f"{w}_probability"), F.col("word_rank").alias(f"{w}_rank"))
            out = out.join(found, f"_id_{w}")
        metrics = ["argmax", "maxprob", "entropy", *[f"{w}_{m}" for w in words for m in ("probability", "rank")]]
        return out.select(*df.columns, *metrics)


def dist_metrics_long(
    df: DataFrame, key: list[str], token: str, score_col: str, target: str | Column
) -> DataFrame:
    """Softmax metrics from one row per (context, token, score).

    Two aggregations over the same keys: the first finds the best score and the target's score, the
    second sums the shifted exponentials.  Both combine on the map side.
    """
    target = F.col(target) if isinstance(target, str) else target
    s = F.col(score_col).cast("double")
    rows = df.select(*key, F.col(token).alias("_t"), s.alias("_s"), target.alias("_w"))
    head = rows.groupBy(*key).agg(
        F.max("_s").alias("_max"),
        F.max(F.when(F.col("_t") == F.col("_w"), F.col("_s"))).alias("_target"),
        # Best score first, then the lowest token.
        F.min(F.struct((-F.col("_s")).alias("s"), F.col("_t").alias("t"))).alias("_best"),
    )
    shifted = F.col("_s") - F.col("_max")
    e = F.exp(shifted)
    out = join_on_group(rows, head, key).groupBy(*key).agg(
        F.sum(e).alias("_z"),
        F.sum(e * shifted).alias("_zs"),
        F.count_if(F.col("_s") > F.col("_target")).alias("_better"),
        F.max("_target").alias("_target"),
        F.max("_max").alias("_max"),
        F.max(F.col("_best.t")).alias("argmax"),
    )
    z = F.col("_z")
    return out.select(
        *key,
        (F.exp(F.col("_target") - F.col("_max")) / z).alias("probability"),
        F.when(F.col("_target").isNotNull(), F.col("_better") + 1).cast("int").alias("rank"),
        "argmax",
        (F.lit(1.0) / z).alias("maxprob"),
        ((F.ln(z) - ratio("_zs", z)) / F.ln(F.lit(2.0))).alias("entropy"),
    )


def assemble_results(
    long: DataFrame, keys: list[str], conditions: tuple[str, ...] = ("isolated", "related", "unrelated"), **extra: Column
) -> DataFrame:
    """Wide result from one row per stimulus and condition.

    Per condition: target probability, rank, argmax and maxprob; then probability and rank of the
    related prime in the isolated and the related context.  One grouping, no pivot job, which also gives ``extra`` aggregates.
    """
    cells = []
    for c in conditions:
        here = F.col("condition") == c
        for name, source in (
            ("probability", "target_probability"),
            ("rank", "target_rank"),
            ("argmax", "argmax"),
            ("maxprob", "maxprob"),
        ):
            cells.append(F.max(F.when(here, F.col(source))).alias(f"{c}_{name}"))
    for c in ("isolated", "related"):
        here = F.col("condition") == c
        for name in ("probability", "rank"):
            cells.append(F.max(F.when(here, F.col(f"related_{name}"))).alias(f"rp_{c}_{name}"))
    return long.groupBy(*keys).agg(*cells, *[c.alias(name) for name, c in extra.items()])
