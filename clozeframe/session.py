"""Session settings for tests and benchmarks; a cluster session brings its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "clozeframe") -> SparkSession:
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clozeframe-checkpoint-"))
    return session


# Whether Spark removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def computed_once(df: DataFrame, release: bool = False) -> DataFrame:
    """The rows computed once: in the checkpoint folder if the session has one (it survives lost executors), else cached.

    With ``release`` the shuffle files of the computation go when it has been written to that folder, and not when the driver next
    collects garbage; a cached copy may need them again and keeps them.

    The library chooses no folder.  Set ``spark.checkpoint.dir`` on a cluster, and
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have files of dropped tables removed.
    """
    context = df.sparkSession.sparkContext
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None and shared:
        context.setCheckpointDir(shared)
    if context.getCheckpointDir() is None:
        return df.persist()
    if not release:
        return df.checkpoint()
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the checkpoint folder, or ``spark.checkpoint.dir``; a local master gets one of its own."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if shared is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="clozeframe-checkpoint-"))
    return context.getCheckpointDir()
