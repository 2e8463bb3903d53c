"""Location shift between two samples: order statistics of all differences, found without forming all pairs.

The shift at which a standardised rank sum crosses a quantile is one of the differences x - y: the one with a known number of
differences above it.  Counting the differences above a trial shift needs no pairs, and few trials are needed:

1. Each sample of a group is cut into bins of about equally many values, by a mergeable sketch.  The bins' ends and sizes bound the count
   for every trial shift, and so give an interval that holds the difference sought.
2. For a bin of the first sample, only the bins of the second that are neither wholly above nor wholly below that interval are
   open.  Each such cell is one bounded task: it gets its values once, whatever the number of trials, and counts for a row of trial shifts
   inside the interval; sums over the cells narrow it.
3. When few differences are left in the interval, cells list them, and the one sought is picked by its rank.

The result is exact for any data: a difference is the floating-point difference of its two values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.operators.joins import join_on_group, small_table
from clozeframe.operators.ordered import part_of
from clozeframe.session import computed_once

# Bins per sample and group at least and at most, and distinct values a bin is meant for; trial shifts per round; differences
# listed per group and rank at most.
LEAST_BINS, MOST_BINS, BIN_VALUES = 512, 8192, 20_000
TRIALS = 64
LISTED = 1_000_000


def above(x: np.ndarray, y: np.ndarray, shift: float) -> np.ndarray:
    """For each x, how many of the ascending ``y`` have x - y > shift in floating point."""
    at = np.searchsorted(y, x - shift, side="left")
    # Rounding moves the border by a value or two.
    while True:
        low = np.flatnonzero((at > 0) & ~(x - y[np.maximum(at - 1, 0)] > shift))
        if not len(low):
            break
        at[low] -= 1
    while True:
        more = np.flatnonzero((at < len(y)) & (x - y[np.minimum(at, len(y) - 1)] > shift))
        if not len(more):
            return at
        at[more] += 1


def _middle(lo: float, hi: float) -> float:
    return lo / 2 + hi / 2


def bracket(x: pd.DataFrame, y: pd.DataFrame, rank: float) -> tuple[float, float]:
    """(lo, hi] that holds the difference of this rank from the top, from bins (least, most, n) in ascending order."""
    total = np.concatenate([[0.0], np.cumsum(y["n"].to_numpy(float))])
    least, most, n = (x[c].to_numpy(float) for c in ("least", "most", "n"))
    y_least, y_most = y["least"].to_numpy(float), y["most"].to_numpy(float)
    surely = lambda t: float(n @ total[above(least, y_most, t)])
    perhaps = lambda t: float(n @ total[above(most, y_least, t)])

    def cross(count) -> tuple[float, float]:
        """Neighbours around the place where the count falls below the rank."""
        lo, hi = np.nextafter(least[0] - y_most[-1], -np.inf), most[-1] - y_least[0]
        while lo < (middle := _middle(lo, hi)) < hi:
            lo, hi = (middle, hi) if count(middle) >= rank else (lo, middle)
        return lo, hi

    return cross(surely)[0], cross(perhaps)[1]


def _cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (root, rank, lo, hi, base, cell, first, last): open bins of y (first to last) for each bin of x, and pairs surely above."""
    bins = pdf[pdf["kind"] != 2].sort_values(["kind", "bin"])
    x, y = bins[bins["kind"] == 0], bins[bins["kind"] == 1]
    total = np.concatenate([[0], np.cumsum(y["n"].to_numpy(np.int64))])
    out = []
    for root, rank in pdf.loc[pdf["kind"] == 2, ["root", "n"]].itertuples(index=False):
        lo, hi = bracket(x, y, rank)
        # Bins whose every difference is above hi, and bins with some difference above lo.
        sure = above(x["least"].to_numpy(float), y["most"].to_numpy(float), hi)
        some = above(x["most"].to_numpy(float), y["least"].to_numpy(float), lo)
        base = int(x["n"].to_numpy(np.int64) @ total[sure])
        for cell, a, b in zip(x["bin"], sure, some, strict=True):
            if a < b:
                out.append((root, rank, lo, hi, base, cell, y["bin"].iloc[a], y["bin"].iloc[b - 1]))
    return pd.DataFrame(out, columns=["root", "rank", "lo", "hi", "base", "cell", "first", "last"])


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values and numbers of both samples of a cell, ascending."""
    pdf = pdf.sort_values("value")
    x, y = pdf[pdf["in_x"]], pdf[~pdf["in_x"]]
    return x["value"].to_numpy(), x["n"].to_numpy(np.int64), y["value"].to_numpy(), y["n"].to_numpy(np.int64)


def _trials(lo: float, hi: float) -> np.ndarray:
    """Shifts cut evenly out of (lo, hi); the ends are not among them."""
    cuts = lo + (hi - lo) * np.arange(1, TRIALS) / TRIALS
    return cuts[(cuts > lo) & (cuts < hi)]


def _counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Differences of a cell above each trial shift and above both ends: as weights and as distinct pairs."""
    x, nx, y, ny = _sides(pdf)
    first = pdf.iloc[0]
    total = np.concatenate([[0], np.cumsum(ny)])
    rows = []
    for shift in [first["lo"], *_trials(first["lo"], first["hi"]), first["hi"]]:
        at = above(x, y, shift)
        rows.append((first["root"], shift, int(nx @ total[at]), int(at.sum())))
    return pd.DataFrame(rows, columns=["root", "shift", "weight", "pairs"])


def _listed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Differences of a cell in (lo, hi], with their weights, and the weight of those above hi."""
    x, nx, y, ny = _sides(pdf)
    first = pdf.iloc[0]
    a, b = above(x, y, first["hi"]), above(x, y, first["lo"])
    total = np.concatenate([[0], np.cumsum(ny)])
    i = np.repeat(np.arange(len(x)), b - a)
    j = np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    found, which = np.unique(x[i] - y[j], return_inverse=True)
    weights = np.zeros(len(found), np.int64)
    np.add.at(weights, which, nx[i] * ny[j])
    rows = pd.DataFrame({"root": first["root"], "shift": found, "weight": weights})
    return pd.concat([rows, pd.DataFrame([(first["root"], np.inf, int(nx @ total[a]))], columns=rows.columns)])


def ranked_differences(counts: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """by, root, shift: the difference x - y of each rank (1: the largest), of value counts (value, na, nb) and (by, root, rank).

    Ranks beyond the number of differences are those of the largest or smallest one.  Groups without one of the samples have no row.
    """
    side = lambda name, in_x: F.struct(F.lit(in_x).alias("in_x"), F.col(name).alias("n"))
    sides = counts.select(*by, "value", F.explode(F.array(side("na", True), side("nb", False))).alias("_s"))
    sides = computed_once(sides.select(*by, "value", "_s.*").where("n > 0"))
    most = sides.groupBy(*by, "in_x").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    n_bins = min(max(LEAST_BINS, 1 << (most // BIN_VALUES).bit_length()), MOST_BINS)
    sketch = F.percentile_approx("value", [k / n_bins for k in range(1, n_bins)], 8 * n_bins)
    edges = sides.groupBy(*by, "in_x").agg(sketch.alias("_edges"))
    binned = computed_once(join_on_group(sides, small_table(edges), [*by, "in_x"]).withColumn("bin", part_of("value", "_edges", n_bins)).drop("_edges"))
    kind = F.when(F.col("in_x"), 0).otherwise(1).alias("kind")
    bins = binned.groupBy(*by, "in_x", "bin").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.sum("n").alias("n"))
    bins = bins.select(*by, kind, "bin", "least", "most", "n", F.lit("").alias("root"))
    totals = sides.groupBy(*by).agg((F.sum(F.when(F.col("in_x"), F.col("n"))) * F.sum(F.when(~F.col("in_x"), F.col("n")))).alias("_pairs"))
    asked = join_on_group(ranks, totals.where("_pairs > 0"), by)
    asked = asked.select(*by, F.lit(2).alias("kind"), F.lit(0).alias("bin"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most"), F.least(F.greatest("rank", F.lit(1)), "_pairs").alias("n"), "root")
    both = bins.join(asked.select(F.struct(*by).alias("_g")).distinct(), F.struct(*by) == F.col("_g"), "left_semi").unionByName(asked)
    keys = [f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in by]
    out = [*keys, "root string", "rank bigint", "lo double", "hi double", "base bigint", "cell int", "first int", "last int"]
    cells = computed_once(_per_group(both, by, _cells, by, out))
    # Each cell: the values of its bin of x, and those of the open bins of y.
    open_bins = cells.withColumn("_b", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("in_x"), F.col("cell").alias("bin"))), F.transform(F.sequence("first", "last"), lambda j: F.struct(F.lit(False).alias("in_x"), j.alias("bin"))))))
    open_bins = open_bins.select(*by, "root", "cell", "_b.*")
    dealt = join_on_group(binned, small_table(open_bins), [*by, "in_x", "bin"])
    dealt = computed_once(dealt.select(*by, "root", "cell", "in_x", "value", "n"))
    state = computed_once(cells.select(*by, "root", "rank", "base", "lo", "hi").distinct())
    key = [*by, "root"]
    done = None
    while True:
        placed = join_on_group(dealt, small_table(state), key)
        sums = _per_group(placed, [*key, "cell"], _counts, by, [*keys, "root string", "shift double", "weight bigint", "pairs bigint"])
        sums = sums.groupBy(*key, "shift").agg(F.sum("weight").alias("weight"), F.sum("pairs").alias("pairs"))
        sums = join_on_group(sums, small_table(state), key).withColumn("_over", F.col("weight") + F.col("base") >= F.col("rank"))
        lower, upper = F.max(F.when(F.col("_over"), F.col("shift"))), F.min(F.when(~F.col("_over"), F.col("shift")))
        pairs = F.max(F.when(~F.col("_over"), F.col("pairs"))), F.min(F.when(F.col("_over"), F.col("pairs")))
        narrowed = sums.groupBy(*key, "rank", "base").agg(lower.alias("lo"), upper.alias("hi"), (pairs[1] - pairs[0]).alias("open"))
        narrowed = computed_once(narrowed)
        # Rounds end where few pairs are left or no shift lies between the ends: then one difference is left.
        ready = (F.col("open") <= LISTED) | (F.col("lo") >= F.col("lo") / 2 + F.col("hi") / 2) | (F.col("hi") <= F.col("lo") / 2 + F.col("hi") / 2)
        finished = computed_once(narrowed.where(ready).select(*key, "rank", "base", "lo", "hi"))
        done = finished if done is None else computed_once(done.unionByName(finished))
        state = computed_once(narrowed.where(~ready).select(*key, "rank", "base", "lo", "hi"))
        if state.isEmpty():
            break
    listed = _per_group(join_on_group(dealt, small_table(done), key), [*key, "cell"], _listed, by, [*keys, "root string", "shift double", "weight bigint"])
    listed = listed.groupBy(*key, "shift").agg(F.sum("weight").alias("weight"))
    # At most LISTED differences per group and root.
    down = Window.partitionBy(*key).orderBy(F.col("shift").desc()).rowsBetween(Window.unboundedPreceding, 0)
    listed = join_on_group(listed.withColumn("_up_to", F.sum("weight").over(down)), done.select(*key, "rank", "base"), key)
    reached = F.col("_up_to") + F.col("base") >= F.col("rank")
    return listed.where(F.col("shift") < float("inf")).groupBy(*key).agg(F.max(F.when(reached, F.col("shift"))).alias("shift"))


def _per_group(df: DataFrame, group: list[str], fn, by: list[str], out: list[str]) -> DataFrame:
    """``fn`` applied to the rows of each group, with the columns ``by`` put before its result."""
    columns = [part.rsplit(" ", 1)[0].strip("`") for part in out]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fn(pdf)
        for k in by:
            found[k] = pdf[k].iloc[0]
        return found[columns]

    return df.groupBy(*group).applyInPandas(run, ", ".join(out))
