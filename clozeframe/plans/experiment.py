"""Scoring runs from stimuli to result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozeframe.functions.text import mask_index
from clozeframe.operators.cloze import ClozeModel, mask_neighbours, score_cloze
from clozeframe.operators.joins import join_on_group
from clozeframe.operators.scoring import Scorer, ScoreStore, assemble_results, prime_metrics, row_id, score
from clozeframe.operators.stimuli import build_stimuli, conditions_long
from clozeframe.sources.schemas import (
    CONDITIONS,
    ENTROPY_RESULT,
    LEGACY_PRIMING_RESULT,
    LEGACY_STIMULI,
    PRIMING_RESULT,
    STIMULI,
)
from clozeframe.sources.writers import write_table

# What a row of one stimulus and condition carries of the stimulus beside its id; contexts are long and move as little as can be.
WORDS = ["target", "related", "unrelated", "relation"]


def _dealt(rows: DataFrame, context: str, tasks: int | None = None) -> DataFrame:
    """Rows of one isolated context together in one task, so that contexts made of it are scored there without moving again."""
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, context).sortWithinPartitions(context)


def _run(
    stimuli: DataFrame, mode: str, score_long: Callable[[DataFrame], DataFrame], deal: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Copies of a stimulus are scored once and repeated at the end.

    A stimulus is known by a hash while it is scored.  Only its isolated row keeps a context; the primed ones are made again
    from it at the end.
    """
    names = STIMULI.fieldNames()
    counted = stimuli.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_id", row_id(names))
    built = build_stimuli(deal(counted) if deal else counted, mode)
    keys = ["_id", *WORDS, "_copies"]
    long = score_long(conditions_long(built, keys))
    isolated = F.max(F.when(F.col("condition") == "isolated", F.col("cloze")))
    wide = build_stimuli(assemble_results(long, keys, context=isolated), mode)
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return wide.withColumn("_copy", copy).select(*PRIMING_RESULT.fieldNames())


def run_priming(stimuli: DataFrame, load_scorer: Callable[[], Scorer], mode: str = "word", **options) -> DataFrame:
    """The 23-column priming result with a batch model."""
    if options.get("store") is not None or options.get("salts", 1) > 1:
        return _run(stimuli, mode, lambda long: prime_metrics(long, load_scorer, **options))
    deal = lambda rows: _dealt(rows, "context", options.get("tasks"))
    return _run(stimuli, mode, lambda long: prime_metrics(long, load_scorer, **options, dealt=True), deal)


def run_priming_cloze(stimuli: DataFrame, model: ClozeModel, mode: str = "word") -> DataFrame:
    """The 23-column priming result with the count-based cloze model.

    A stimulus is known by a hash while it is scored, by its words and neighbours alone.  Its texts move once, to where its
    answers are put together; copies are counted on the way and repeated at the end.
    """
    names = STIMULI.fieldNames()
    own = stimuli.select(*names).withColumn("_id", row_id(names))
    long = mask_neighbours(conditions_long(build_stimuli(own, mode), ["_id", "target", "related"]), mask_index=None)
    scored = score_cloze(long.drop("cloze", "mask_index"), model, ("target", "related")).drop("prev", "next", "target", "related")
    parts = scored.unionByName(own.withColumn("_copies", F.lit(1).cast("bigint")), allowMissingColumns=True)
    texts = {name: F.max(name) for name in names}
    wide = build_stimuli(assemble_results(parts, ["_id"], _copies=F.sum("_copies"), **texts), mode)
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return wide.withColumn("_copy", copy).select(*PRIMING_RESULT.fieldNames())


def run_constraint(stimuli: DataFrame, load_scorer: Callable[[], Scorer], **options) -> DataFrame:
    """Constraint (maximum probability) and entropy of the isolated context of each stimulus."""
    built = build_stimuli(stimuli.select(*STIMULI.fieldNames()))
    long = built.select(*STIMULI.fieldNames(), F.col("context").alias("cloze"), F.col("isolated_mask").alias("mask_index"))
    contexts = long.select("cloze", "mask_index").distinct()
    scored = score(contexts, load_scorer, [], dedupe=False, **options)
    return join_on_group(long, scored, ["cloze", "mask_index"]).select(
        *STIMULI.fieldNames(), F.col("maxprob").alias("constraint"), "entropy"
    )


def run_entropy(contexts: DataFrame, load_scorer: Callable[[], Scorer], **options) -> DataFrame:
    """Entropy of each distinct context, with the constraint it came with (columns ``context, constraint``)."""
    asked = contexts.select("context", "constraint").distinct().withColumn("mask_index", mask_index("context"))
    scored = score(asked.select("context", "mask_index").distinct(), load_scorer, [], context="context", dedupe=False, **options)
    joined = join_on_group(asked, scored, ["context", "mask_index"])
    return joined.select(*ENTROPY_RESULT.fieldNames())


def run_legacy(stimuli: DataFrame, load_scorer: Callable[[], Scorer], **options) -> DataFrame:
    """The 14-column result of stimuli that bring their three contexts: probability and rank of the target in each.

    Copies of a stimulus are scored once and repeated at the end.
    """
    names = LEGACY_STIMULI.fieldNames()
    texts = [f"{c}_context" for c in CONDITIONS]
    counted = stimuli.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_id", row_id(names))
    dealt = options.get("salts", 1) == 1
    counted = _dealt(counted, texts[0], options.get("tasks")) if dealt else counted
    # The isolated row carries the three contexts.
    cloze = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("condition"),
                    F.col(f"{c}_context").alias("cloze"),
                    *[(F.col(t) if c == CONDITIONS[0] else F.lit(None).cast("string")).alias(t) for t in texts],
                )
                for c in CONDITIONS
            ]
        )
    )
    keys = ["_id", *[n for n in names if n not in texts], "_copies"]
    long = counted.select(*keys, cloze.alias("_c")).select(*keys, "_c.*").withColumn("mask_index", mask_index("cloze"))
    scored = score(long, load_scorer, ["target"], **options, dealt=dealt)
    cells = [
        F.max(F.when(F.col("condition") == c, F.col(f"target_{m}"))).alias(f"{c}_{m}")
        for c in CONDITIONS
        for m in ("probability", "rank")
    ]
    wide = scored.groupBy(*keys).agg(*cells, *[F.max(t).alias(t) for t in texts])
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return wide.withColumn("_copy", copy).select(*LEGACY_PRIMING_RESULT.fieldNames())


def finished_cells(spark: SparkSession, path: str) -> set[tuple[str, str]]:
    """(model, scenario) of the cells that a run matrix has written completely."""
    try:
        rows = spark.read.schema("model string, scenario string").parquet(f"{path}{FINISHED}").distinct().collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {(r["model"], r["scenario"]) for r in rows}


# Beside the result table: one row per finished cell.
FINISHED = "_finished"


def run_experiments(
    stimuli: DataFrame,
    scorers: dict[str, Callable[[], Scorer]],
    modes: list[str],
    path: str,
    fmt: str = "parquet",
    store: ScoreStore | None = None,
    again: bool = False,
) -> None:
    """Every model in every mode, written to one table partitioned by model and scenario.

    A cell replaces its own partition and is then entered in a table of finished cells, so a run that is stopped and started again
    goes on where it was and has every row once; ``again`` runs finished cells too.  With a ``store`` contexts that
    several modes share are scored once per model.
    """
    spark = stimuli.sparkSession
    finished = set() if again else finished_cells(spark, path)
    for model, load_scorer in scorers.items():
        for mode in modes:
            if (model, mode) in finished:
                continue
            options = {} if store is None else {"store": store, "model": model}
            result = run_priming(stimuli, load_scorer, mode, **options).withColumns(
                {"model": F.lit(model), "scenario": F.lit(mode)}
            )
            write_table(result, path, fmt, ("model", "scenario"), mode="overwrite")
            done = spark.createDataFrame([(model, mode)], "model string, scenario string")
            write_table(done.coalesce(1), f"{path}{FINISHED}", mode="append")
