"""Training-text pipeline: from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next stage's docs.  All but
the last return the columns of docs.

1. toxicity: documents scored 0.3 or more go.
2. line dedup: recurring template lines are taken out of the texts; no document goes.
3. near-dedup: one document of each group of near copies (SimHash of three-word shingles, at most two bits apart) stays.
4. mixing: sources are sent to their target weights; a document sent twice is two rows, one not sent goes.
5. packing: token sequences of at most 2048 ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clozeframe.llm import linededup, mixing, packing, simhash, toxicity
from clozeframe.llm.common import checkpoint_dir, table


# The stages share executors and Python workers one after another, so each holds little.
ROWS_PER_BATCH = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with texts sent to Python in batches of at most ``ROWS_PER_BATCH`` rows (a setting of the session)."""
    docs.sparkSession.conf.set(BATCH_SETTING, ROWS_PER_BATCH)
    return docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(small_batches(docs), table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_recurring_lines(docs).select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(small_batches(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(small_batches(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
# Learnt models, connected components and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def forget(spark: SparkSession, folder: str) -> None:
    """Remove a folder that no later stage reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written under the checkpoint folder and read again.

    A written stage is removed when the next one is written; the last stage reads the last of them whenever the result is asked for.
    The session's batch setting is put back before that.
    """
    checkpoint_dir(spark)
    before = spark.conf.get(BATCH_SETTING)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
        if place:
            forget(spark, f"{folder}/{place - 1}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    spark.conf.set(BATCH_SETTING, before)
    return packed
