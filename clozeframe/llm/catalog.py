"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozeframe.llm import bestfit, divergence, hnsw, langid, linededup, middle, mixing, outliers, packing, pii, rules, simhash, toxicity
from clozeframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.cleaned(table(spark, sf_dir, "documents"))


@query(mixing.SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query(hnsw.SQL)
def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


@query()
def op8_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query(divergence.SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query()
def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"))


@query(middle.SQL)
def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
