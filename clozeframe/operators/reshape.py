"""Sorting, top-k with ties, factor levels, wide/long reshapes, extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.functions.measures import facilitation, rel_facilitation
from clozeframe.operators.joins import PAIR_KEYS, counted_relations, join_lexicon, join_on_group, natural_join
from clozeframe.session import computed_once


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by column names, ``-name`` for descending."""
    return df.orderBy(*[F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys])


def top_n_ties(df: DataFrame, n: int, col: str) -> DataFrame:
    """Rows among the n largest values; rows tied with the n-th stay.

    The n-th value comes from a top-k with one small heap per task; the rows are then filtered in
    place, so ties never gather in one task.
    """
    cut = df.select(col).where(F.col(col).isNotNull()).orderBy(F.desc(col)).limit(n).agg(F.min(col)).scalar()
    return df.where(F.col(col) >= cut)


def with_levels(df: DataFrame, col: str, by: str, out: str | None = None) -> DataFrame:
    """Ordinal of a categorical column, levels ordered by descending ``by`` and then by name.

    Only the distinct levels are ranked, however many they are: they are sorted by range, numbered inside each range, and the
    sizes of earlier ranges (one number per partition) are added.  A NULL level is a level of its own, first among equals.
    """
    order = [F.desc("_by"), F.asc(col)]
    levels = df.groupBy(col).agg(F.max(by).alias("_by"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = computed_once(levels.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    earlier = F.array(*[F.lit(sum(sizes.get(k, 0) for k in range(part))).cast("bigint") for part in range(parts)])
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.get(earlier, F.col("_part"))
    ranked = placed.select(F.col(col), number.cast("int").alias(out or f"{col}_ord"))
    return join_on_group(df, ranked, [col])


def distinct_on(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def unique_contexts(
    df: DataFrame, cols: tuple[str, ...] = ("isolated_context", "constraint", "category")
) -> DataFrame:
    """Contexts to score once each."""
    return distinct_on(df, list(cols))


def to_long(df: DataFrame, cols: list[str], key: str, value: str) -> DataFrame:
    return df.unpivot([c for c in df.columns if c not in cols], cols, key, value)


def to_wide(df: DataFrame, ids: list[str], key: str, value: str, keys: list[str], prefix: str = "") -> DataFrame:
    """One column per key value; more than one row for a cell is an error."""
    return to_wide_multi(df, ids, key, [value], keys, lambda v, k: f"{prefix}{k}")


def to_wide_multi(
    df: DataFrame, ids: list[str], key: str, values: list[str], keys: list[str], name=lambda v, k: f"{v}_{k}"
) -> DataFrame:
    """One column per (value column, key value), all keys of one value column side by side.

    ``keys`` is given, so no job runs to find it.
    """
    cells = []
    for v in values:
        for k in keys:
            here = F.col(key) == F.lit(k)
            rows = F.count_if(here)
            too_many = F.raise_error(F.concat(F.lit("several rows for cell "), F.lit(f"{v}, {k}")))
            cells.append(
                F.when(rows > 1, too_many.cast(df.schema[v].dataType))
                .otherwise(F.max(F.when(here, F.col(v))))
                .alias(name(v, k))
            )
    return df.groupBy(*ids).agg(*cells)


def example_extract(df: DataFrame, lex: DataFrame, targets: list[str], primes: list[str]) -> DataFrame:
    """Chosen items with renamed columns and facilitation, in report order."""
    chosen = df.where(F.col("target").isin(targets) & F.col("related").isin(primes))
    out = join_lexicon(chosen, lex).select(
        "model",
        F.col("dataset").alias("scenario"),
        F.col("category").alias("bucket"),
        "constraint",
        "target",
        "related",
        "unrelated",
        "relation",
        F.col("isolated_context").alias("unprimed_context"),
        "related_context",
        "unrelated_context",
        facilitation().alias("facilitation"),
    )
    return order_by(out, "bucket", "-scenario", "model")


def mispriming_list(df: DataFrame, lex: DataFrame, min_bin: int = 7, bucket: str = "category") -> DataFrame:
    """Items above a constraint bin where the related prime hurt, with their relation."""
    hurt = df.where(F.col(bucket) > min_bin).withColumns(
        {"f": facilitation(), "rf": rel_facilitation()}
    )
    hurt = hurt.where(F.col("f") < 0).select(
        F.col(bucket).alias("constraint"),
        F.col("context_type").alias("scenario"),
        "target",
        "related",
        "unrelated",
        "isolated_context",
        "model",
        "f",
        "rf",
    )
    return join_lexicon(hurt, lex)


def negative_facilitation(df: DataFrame) -> DataFrame:
    """All rows with negative facilitation."""
    return df.withColumn("facilitation", facilitation()).where(F.col("facilitation") < 0)


def special_targets(df: DataFrame, min_bin: int = 7, bucket: str = "category") -> DataFrame:
    """Targets of strongly constrained items where the unrelated prime did not leave the target on top."""
    return distinct_on(df.where((F.col(bucket) > min_bin) & (F.col("unrelated_rank") != 1)), ["target"])


def instance_table(
    df: DataFrame, lex: DataFrame, top: DataFrame, columns: list[str], kind: str = "bits"
) -> DataFrame:
    """Single results with relation, relation count and facilitation, for the counted relations only.

    The lexicon is cut to the counted relations first, so other results drop out at the first join; missing keys match missing ones.
    """
    joined = natural_join(df, counted_relations(lex, top), PAIR_KEYS)
    return joined.withColumn("facilitation", facilitation(kind=kind)).select(
        *columns, "relation", "n", "facilitation"
    )
