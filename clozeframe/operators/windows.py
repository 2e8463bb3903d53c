"""Per-group values attached to rows.

Group values are aggregated with map-side combining, measured, and joined back: by broadcast if they
are small, so the rows are not moved at all.  A group holding a large part of the rows is never sorted
or buffered in one task.  Windows are used only where a group has a
known small size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.functions.measures import ratio
from clozeframe.operators.joins import attach_single_row, join_on_group, small_table


def extreme_rows(df: DataFrame, by: list[str], col: str, which: str = "max") -> DataFrame:
    """Rows attaining the group maximum or minimum, ties included."""
    best = {"max": F.max, "min": F.min}[which](col).alias("_best")
    per_group = small_table(df.groupBy(*by).agg(best))
    return join_on_group(df, per_group, by).where(F.col(col) == F.col("_best")).drop("_best")


def zscore(df: DataFrame, by: list[str], col: str, out: str | None = None, scale: bool = True) -> DataFrame:
    """Values centred on the group mean and, with ``scale``, divided by the group deviation."""
    per_group = small_table(df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_sd")))
    centred = F.col(col) - F.col("_m")
    value = ratio(centred, "_sd") if scale else centred
    return join_on_group(df, per_group, by).withColumn(out or f"{col}_standardized", value).drop("_m", "_sd")


def attach_global_mean(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Attach global aggregates (name to aggregate expression) to every row."""
    return attach_single_row(df, df.agg(*[c.alias(name) for name, c in cols.items()]))


# Number of ordered contexts per item (ten constraint bins, then the neutral one).
CONTEXTS_PER_ITEM = 11


def _ordered_items(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Rows with position ``_rn`` 1..11 in their item; any other group size raises.

    The position filter lets Spark cut each map task's share of an item to one row more than allowed
    before the shuffle, enough to notice an oversized group without gathering it.
    """
    group = Window.partitionBy(*keys)
    first = df.withColumn("_rn", F.row_number().over(group.orderBy(ordinal))).where(
        F.col("_rn") <= CONTEXTS_PER_ITEM + 1
    )
    size = F.max("_rn").over(group)
    wrong = F.raise_error(F.concat(F.lit("group without exactly 11 rows, found "), size.cast("string")))
    return first.withColumn(
        "_rn", F.when(size == CONTEXTS_PER_ITEM, F.col("_rn")).otherwise(wrong.cast("int"))
    )


def assign_bucket(df: DataFrame, keys: list[str], ordinal: str, out: str = "bucket") -> DataFrame:
    """Buckets 1..10 by order within the item, the eleventh row gets bucket 0."""
    ordered = _ordered_items(df, keys, ordinal)
    return ordered.withColumn(out, F.col("_rn") % F.lit(CONTEXTS_PER_ITEM)).drop("_rn")


def bucket_trend_corr(df: DataFrame, keys: list[str], ordinal: str, value: str, out: str = "corr") -> DataFrame:
    """Correlation of the ordered values with 10, 9, .., 0 within each item, attached to every row."""
    ordered = _ordered_items(df, keys, ordinal)
    falling = (F.lit(CONTEXTS_PER_ITEM) - F.col("_rn")).cast("double")
    return ordered.withColumn(out, F.corr(F.col(value).cast("double"), falling).over(Window.partitionBy(*keys))).drop("_rn")


def ranked(
    df: DataFrame, by: list[str], order: list[str], limit: int, kind: str = "row_number", out: str = "rank"
) -> DataFrame:
    """Rows at positions up to ``limit`` in their group, by ``row_number``, ``rank`` or ``dense_rank``.

    ``-name`` sorts descending.  Spark prunes each map task to the limit before the shuffle.  Kinds that
    keep ties rank the distinct order values and join them back, so tied rows never gather in one task.
    """
    names = [k.removeprefix("-") for k in order]
    ordering = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in order]
    window = Window.partitionBy(*by).orderBy(*ordering)
    if kind == "row_number":
        return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= limit)
    values = df.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_n"))
    values = values.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= limit)
    earlier = F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    position = {"rank": earlier + 1, "dense_rank": F.col("_rn")}[kind]
    kept = values.withColumn(out, position.cast("int")).where(F.col(out) <= limit)
    return join_on_group(df, kept.drop("_n", "_rn"), [*by, *names])
