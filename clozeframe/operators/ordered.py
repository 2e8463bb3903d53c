"""Exact order statistics of large groups: running counts by value, quantiles, box plots, densities.

A group is never sorted as a whole.  Rows are first counted per distinct value, with map-side combining.  A mergeable quantile sketch
of a group's distinct values then gives the edges of parts of about equal size, whatever the distribution; counts per part give the number
of rows before each part, and a running count inside each part gives the rest.  The result is exact for any data; the sketch
only decides how evenly the work spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.functions.measures import ColumnLike, as_column, finite
from clozeframe.operators.joins import join_on_group, small_table
from clozeframe.session import computed_once

# Parts that the distinct values of a group are dealt to.
PARTS = 256


def part_of(value: ColumnLike, edges: ColumnLike, parts: int) -> Column:
    """How many of the ascending edges (fewer than ``parts``, a power of two) are at most the value, by halving steps."""
    v, e = as_column(value), as_column(edges)
    steps = F.array(*[F.lit(1 << k) for k in range(parts.bit_length() - 2, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(e, at + step - 1) <= v, at + step).otherwise(at))


def value_counts(df: DataFrame, by: list[str], value: ColumnLike, **counts: Column) -> DataFrame:
    """by, value, n and extra counts per distinct non-null value."""
    rows = df.withColumn("value", finite(value)).where(F.col("value").isNotNull())
    # -0.0 and 0.0 are one value.
    rows = rows.withColumn("value", F.col("value") + F.lit(0.0))
    return rows.groupBy(*by, "value").agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in counts.items()]
    )


def ranged(counts: DataFrame, by: list[str]) -> DataFrame:
    """Value counts with their ``part``: ranges of the group's values that hold about equally many distinct values each."""
    sketch = F.percentile_approx("value", [k / PARTS for k in range(1, PARTS)], 8 * PARTS)
    edges = counts.groupBy(*by).agg(sketch.alias("_edges"))
    return join_on_group(counts, small_table(edges), by).withColumn("part", part_of("value", "_edges", PARTS)).drop("_edges")


def running_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``before``, the number of rows with a smaller value in the group, to value counts.

    Group and part form one struct key, so that the running count in a part and the join to its offset share one partitioning.
    Offsets are running sums over the parts of a group, at most ``PARTS`` of them.
    """
    placed = ranged(computed_once(counts), by).withColumn("_key", F.struct(*by, "part")).drop("part")
    per_part = placed.groupBy("_key").agg(F.sum("n").alias("_rows"))
    earlier = Window.partitionBy(*[F.col(f"_key.{k}") for k in by]).orderBy("_key.part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_key", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    in_part = Window.partitionBy("_key").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("n").over(in_part), F.lit(0)))
    joined = local.join(offsets, "_key")
    return joined.withColumn("before", F.col("_offset") + F.col("_local")).drop("_key", "_offset", "_local")


def quantiles(df: DataFrame, by: list[str], value: ColumnLike, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, linear between order statistics; one column per name in ``probs``."""
    counts = value_counts(df, by, value)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    placed = join_on_group(running_counts(counts, by), totals, by)
    value_at = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        value_at += [
            F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value"))).alias(
                f"_{name}_{end}"
            )
            for end, k in (("low", low), ("high", high))
        ]
    picked = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *value_at)
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*by, F.col("_total").alias("n"), *out)


def box_stats(df: DataFrame, by: list[str], value: ColumnLike) -> DataFrame:
    """Five-number summary and whisker ends (last values within 1.5 IQR of the box)."""
    rows = df.withColumn("_v", finite(value))
    box = small_table(quantiles(rows, by, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    ends = join_on_group(rows.select(*by, "_v"), box, by)
    return ends.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.min("_v").alias("min"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.max("_v").alias("max"),
        F.min(F.when(F.col("_v") >= F.col("q1") - reach, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= F.col("q3") + reach, F.col("_v"))).alias("whisker_high"),
    )


def density(df: DataFrame, by: list[str], value: ColumnLike, grid: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on an even grid, with the rule-of-thumb bandwidth.

    Each value is split between its two neighbouring grid points in proportion to nearness, so a
    group shrinks to at most ``grid`` weights before the kernel is applied.
    """
    rows = df.withColumn("_v", finite(value)).where(F.col("_v").isNotNull()).select(*by, "_v")
    spread = rows.groupBy(*by).agg(
        F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    box = quantiles(rows, by, "_v", {"_q1": 0.25, "_q3": 0.75})
    iqr = (F.col("_q3") - F.col("_q1")) / F.lit(1.34)
    narrow = F.least(F.col("_sd"), iqr)
    scale = F.coalesce(
        F.nullif(narrow, F.lit(0.0)), F.nullif(F.col("_sd"), F.lit(0.0)), F.nullif(F.abs("_min"), F.lit(0.0)), F.lit(1.0)
    )
    setup = join_on_group(spread, box, by).withColumn(
        "bw", F.lit(0.9) * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    )
    setup = setup.withColumn("_from", F.col("_min") - F.lit(cut) * F.col("bw"))
    setup = setup.withColumn(
        "_step", (F.col("_max") + F.lit(cut) * F.col("bw") - F.col("_from")) / F.lit(float(grid - 1))
    ).select(*by, "n", "bw", "_from", "_step")
    setup = small_table(setup)
    place = (F.col("_v") - F.col("_from")) / F.col("_step")
    cell = F.floor(place)
    split = join_on_group(rows, setup, by).select(
        *by, cell.alias("_cell"), (place - cell).alias("_right")
    )
    per_cell = split.groupBy(*by, "_cell").agg(
        F.sum(F.lit(1.0) - F.col("_right")).alias("_w0"), F.sum("_right").alias("_w1")
    )
    # One row per group, with at most ``grid`` entries.
    weights = per_cell.groupBy(*by).agg(F.collect_list(F.struct("_cell", "_w0", "_w1")).alias("_weights"))

    def kernel(i: Column, j: Column) -> Column:
        z = (i - j).cast("double") * F.col("_step") / F.col("bw")
        return F.exp(F.lit(-0.5) * z * z)

    points = F.transform(
        F.sequence(F.lit(0), F.lit(grid - 1)),
        lambda i: F.struct(
            (F.col("_from") + i * F.col("_step")).alias("x"),
            (
                F.aggregate(
                    "_weights",
                    F.lit(0.0),
                    lambda acc, w: acc + w["_w0"] * kernel(i, w["_cell"]) + w["_w1"] * kernel(i, w["_cell"] + 1),
                )
                / (F.col("n") * F.col("bw") * F.lit((2.0 * 3.141592653589793) ** 0.5))
            ).alias("density"),
        ),
    )
    return join_on_group(weights, setup, by).select(
        *by, "bw", F.posexplode(points).alias("point", "_p")
    ).select(*by, "bw", "point", F.col("_p.x").alias("x"), F.col("_p.density").alias("density"))
