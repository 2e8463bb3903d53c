"""Quality rules: base limits, then robust multivariate outliers by minimum covariance determinant.

Per language and source the operator looks for the share ``SHARE`` of the documents whose statistic vectors have the
covariance of least determinant, by concentration steps: from a mean and covariance take the documents with the
smallest Mahalanobis distances, estimate both from them, and repeat.  The start is the coordinate-wise
median and spread.  Distances go to a histogram per group, so the nearest part is found by counts and no group is gathered or
sorted; moments are sums.  Both combine before the shuffle, so a group with a third of all rows is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.llm.common import attach, kept
from clozeframe.llm.statistics import with_statistics

MIN_WORDS = 50
SHARE = 0.75
STEPS = 4
# Groups with fewer documents are estimated together.
MIN_GROUP = 200
# Chi-squared distribution, 5 degrees of freedom: median, and the 0.9999 quantile beyond which a document is rejected.
MEDIAN, CUTOFF = 4.351, 25.745
# Least standard deviations of the transformed statistics, so that a constant one rejects no small change.  For the shares it is a third
# of what one repeat makes in a short text (a repeated window in 50 words, a line in 10): the estimated covariance decides on more.
FLOOR = (0.35, 0.12, 0.25, 0.25, 0.25)
P = len(FLOOR)
BINS_PER_OCTAVE = 16
KEYS = ["g_lang", "g_source", "g_small"]


def vector() -> list[Column]:
    """Transformed statistics: length, word length, and log shares of symbols, repeated lines and repeated words."""
    s = lambda name: F.col(f"stats.{name}").cast("double")
    share = lambda a, b, start: F.log(start + s(a) / F.greatest(s(b), F.lit(1.0)))
    return [
        F.log1p(s("n_words")),
        F.log((s("word_chars") + 1) / (s("n_words") + 1)),
        share("n_symbols", "word_chars", 0.01),
        share("n_dup_lines", "n_lines", 0.1),
        share("n_repeat_words", "n_words", 0.1),
    ]


def _x(j: int) -> Column:
    return F.get("x", F.lit(j))


def start(rows: DataFrame) -> DataFrame:
    """Median and floored spread per group, as a mean and a diagonal factor."""
    medians = kept(rows.groupBy(*KEYS).agg(F.array(*[F.percentile_approx(_x(j), 0.5, 1000) for j in range(P)]).alias("mean")))
    spread = [1.4826 * F.percentile_approx(F.abs(_x(j) - F.get("mean", F.lit(j))), 0.5, 1000) for j in range(P)]
    spreads = attach(rows, medians, KEYS).groupBy(*KEYS).agg(F.array(*[F.greatest(v, F.lit(f)) for v, f in zip(spread, FLOOR, strict=True)]).alias("sd"))
    factor = [F.get("sd", F.lit(j)) if k == j else F.lit(0.0) for j in range(P) for k in range(j + 1)]
    return kept(attach(medians, kept(spreads), KEYS).select(*KEYS, "mean", F.array(*factor).alias("factor"), F.lit(1.0).alias("scale")))


def distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from ``mean`` with the lower triangular ``factor`` of the covariance."""
    z: list[Column] = []
    for j in range(P):
        low = lambda k, j=j: F.get("factor", F.lit(j * (j + 1) // 2 + k))
        rest = _x(j) - F.get("mean", F.lit(j))
        for k in range(j):
            rest = rest - low(k) * z[k]
        z.append(rest / low(j))
    return sum((v * v for v in z[1:]), z[0] * z[0]) / F.col("scale")


def measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    return attach(rows, estimate, KEYS).withColumn("d2", distance())


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * BINS_PER_OCTAVE).cast("int")


def quantile_bins(near: DataFrame) -> DataFrame:
    """Per group the histogram cell of the distances in which ``SHARE`` and half of the rows are reached."""
    counts = near.groupBy(*KEYS, _bin(F.col("d2")).alias("bin")).count()
    by = Window.partitionBy(*KEYS)
    upto = F.sum("count").over(by.orderBy("bin"))
    total = F.sum("count").over(by)
    counts = counts.withColumn("upto", upto).withColumn("total", total)
    reached = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("bin")))
    return kept(counts.groupBy(*KEYS).agg(reached(SHARE).alias("last"), reached(0.5).alias("middle")))


def concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step."""
    near = measured(rows, estimate).drop("mean", "factor", "scale")
    bins = quantile_bins(near)
    inner = attach(near, bins, KEYS).where(_bin(F.col("d2")) <= F.col("last"))
    pairs = [(j, k) for j in range(P) for k in range(j + 1)]
    sums = inner.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(_x(j)) for j in range(P)]).alias("mean"),
        F.array(*[F.covar_pop(_x(j), _x(k)) for j, k in pairs]).alias("cov"),
    )
    # Cholesky factor of the covariance, each diagonal element floored.
    for j, k in pairs:
        rest = F.get("cov", F.lit(j * (j + 1) // 2 + k))
        for i in range(k):
            rest = rest - F.col(f"l{j}{i}") * F.col(f"l{k}{i}")
        value = F.sqrt(F.greatest(rest, F.lit(FLOOR[j] ** 2))) if j == k else rest / F.col(f"l{k}{k}")
        sums = sums.withColumn(f"l{j}{k}", value)
    return kept(sums.select(*KEYS, "mean", F.array(*[F.col(f"l{j}{k}") for j, k in pairs]).alias("factor"), F.lit(1.0).alias("scale")))


def rescaled(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate with its covariance enlarged until the median distance is that of the chi-squared distribution."""
    bins = quantile_bins(measured(rows, estimate))
    middle = F.pow(F.lit(2.0), (F.col("middle") + 0.5) / BINS_PER_OCTAVE)
    scale = F.greatest(F.lit(1.0), middle / MEDIAN)
    return kept(attach(estimate, bins, KEYS).withColumn("scale", scale).select(*KEYS, "mean", "factor", "scale"))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """doc_id, lang, source, the six base statistics, base_failed, distance, kept of every row.

    A row fails the base with under 50 words or with over half of its words in repeated windows; NULL and empty texts do.  Rows that
    pass are kept unless their distance is over the cutoff.  NULL languages and sources are groups of their own;
    groups under 200 passing rows are estimated together.  Repeated rows count as often as given, other columns are ignored,
    an empty table gives an empty result.
    """
    s = F.col("stats")
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    rows = with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text")
    rows = kept(rows.withColumn("base_failed", failed).withColumn("x", F.array(*vector())))
    passing = rows.where(~F.col("base_failed"))
    counts = kept(passing.groupBy("lang", "source").agg(F.count("*").alias("n_group")))
    small = F.col("n_group") < MIN_GROUP
    passing = attach(passing, counts, ["lang", "source"]).select(
        "x", F.when(~small, F.col("lang")).alias("g_lang"), F.when(~small, F.col("source")).alias("g_source"), small.alias("g_small")
    )
    estimate = start(passing)
    for _ in range(steps):
        estimate = concentrate(passing, estimate)
    estimate = rescaled(passing, estimate)

    groups = counts.select("lang", "source", F.when(~small, F.col("lang")).alias("g_lang"), F.when(~small, F.col("source")).alias("g_source"), small.alias("g_small"))
    # Groups without a passing row have no estimate, and their rows fail the base.
    by_group = kept(attach(groups, estimate, KEYS).drop(*KEYS))
    left = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    right = attach(passing_rows(rows), by_group, ["lang", "source"]).withColumn("distance", distance()).drop("mean", "factor", "scale")
    return left.unionByName(right).select(
        "doc_id", "lang", "source",
        *[F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False))).alias("kept"),
    )


def passing_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("base_failed"))
