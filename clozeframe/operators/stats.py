"""Regressions, correlations and tests, one row per group.

Raw rows are reduced by built-in aggregates; only the finished statistic of each group goes through a
tail function.  Each function can leave out p-values (``p_values=False``) and then stays JVM-only.
Rows with a missing value in a used column stay out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozeframe.functions import tails
from clozeframe.functions.measures import ColumnLike, finite, ratio
from clozeframe.operators.joins import join_on_group
from clozeframe.operators.ordered import running_counts, value_counts
from clozeframe.operators.shift import ranked_differences
from clozeframe.session import computed_once


def _pairs(df: DataFrame, by: list[str], y: ColumnLike, x: ColumnLike) -> DataFrame:
    rows = df.select(*by, finite(y).alias("_y"), finite(x).alias("_x"))
    return rows.where(F.col("_y").isNotNull() & F.col("_x").isNotNull())


def _line_sums(df: DataFrame, by: list[str], y: ColumnLike, x: ColumnLike) -> DataFrame:
    return _pairs(df, by, y, x).groupBy(*by).agg(
        F.count(F.lit(1)).alias("nobs"),
        F.avg("_x").alias("mean_x"),
        F.avg("_y").alias("mean_y"),
        F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_sxy("_y", "_x").alias("sxy"),
        F.regr_syy("_y", "_x").alias("syy"),
    )


def _with_line(sums: DataFrame) -> DataFrame:
    slope = ratio("sxy", "sxx")
    return sums.withColumn("slope", slope).withColumns(
        {
            "intercept": F.col("mean_y") - F.col("slope") * F.col("mean_x"),
            "deviance": F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
            + F.lit(0.0) * F.col("slope"),
            "df_residual": F.col("nobs") - 2,
        }
    )


def lm_glance(
    df: DataFrame, by: list[str], y: ColumnLike, x: ColumnLike, scale_x: bool = False, p_values: bool = True
) -> DataFrame:
    """Simple regression y ~ x per group, with the usual one-line model summary.

    ``scale_x`` regresses on the z-score of x inside the group.  Standardising changes slope and
    intercept by known factors and nothing else, so no second pass is needed.
    """
    line = _with_line(_line_sums(df, by, y, x))
    n = F.col("nobs").cast("double")
    rss = F.col("deviance")
    r2 = ratio(F.col("slope") * F.col("sxy"), "syy")
    ms = ratio(rss, "df_residual")
    loglik = F.lit(-0.5) * n * (F.ln(F.lit(2 * math.pi) * F.nullif(rss, F.lit(0.0)) / n) + 1.0)
    slope, intercept = F.col("slope"), F.col("intercept")
    if scale_x:
        sd = F.sqrt(ratio("sxx", F.col("nobs") - 1))
        slope, intercept = slope * sd, F.col("mean_y") + F.lit(0.0) * slope
    out = line.select(
        *by,
        slope.alias("slope"),
        intercept.alias("intercept"),
        r2.alias("r_squared"),
        (F.lit(1.0) - (F.lit(1.0) - r2) * ratio(n - 1.0, "df_residual")).alias("adj_r_squared"),
        F.sqrt(ms).alias("sigma"),
        ratio(F.col("slope") * F.col("sxy"), ms).alias("statistic"),
        F.lit(1).alias("df"),
        loglik.alias("logLik"),
        (F.lit(-2.0) * loglik + 6.0).alias("AIC"),
        (F.lit(-2.0) * loglik + F.lit(3.0) * F.ln(n)).alias("BIC"),
        rss.alias("deviance"),
        "df_residual",
        "nobs",
    )
    return out.withColumn("p_value", tails.f_p_value("statistic", "df", "df_residual")) if p_values else out


def fit_band(
    df: DataFrame, by: list[str], y: ColumnLike, x: ColumnLike, grid: int = 80, level: float = 0.95, band: bool = True
) -> DataFrame:
    """Fitted line on an even grid over the range of x, with its standard error and confidence band."""
    ranges = _pairs(df, by, y, x).groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    line = join_on_group(_with_line(_line_sums(df, by, y, x)), ranges, by)
    if band:
        line = line.withColumn("_t", tails.t_critical(0.5 + level / 2, F.nullif(F.greatest("df_residual", F.lit(0)), F.lit(0))))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(grid - 1))
    points = line.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    points = points.withColumn("x", F.col("_lo") + F.col("point") * step)
    away = F.col("x") - F.col("mean_x")
    se = F.sqrt(ratio("deviance", "df_residual")) * F.sqrt(
        F.lit(1.0) / F.col("nobs") + ratio(away * away, "sxx")
    )
    points = points.withColumns({"fit": F.col("intercept") + F.col("slope") * F.col("x"), "se": se})
    out = [*by, "point", "x", "fit", "se"]
    if band:
        points = points.withColumns(
            {"lower": F.col("fit") - F.col("_t") * F.col("se"), "upper": F.col("fit") + F.col("_t") * F.col("se")}
        )
        out += ["lower", "upper"]
    return points.select(*out)


def corr_by(df: DataFrame, by: list[str], x: ColumnLike, y: ColumnLike) -> DataFrame:
    """Pearson correlation per group."""
    return _pairs(df, by, y, x).groupBy(*by).agg(F.corr("_x", "_y").alias("correlation"))


def cor_test(df: DataFrame, by: list[str], x: ColumnLike, y: ColumnLike, level: float = 0.95, p_values: bool = True) -> DataFrame:
    """Correlation with t statistic and Fisher-z confidence interval."""
    out = _pairs(df, by, y, x).groupBy(*by).agg(
        F.corr("_x", "_y").alias("estimate"), F.count(F.lit(1)).alias("_n")
    )
    r, n = F.col("estimate"), F.col("_n").cast("double")
    reach = F.lit(tails.normal_quantile(0.5 + level / 2)) / F.sqrt(F.when(n > 3, n - 3.0))
    out = out.select(
        *by,
        "estimate",
        (r * F.sqrt(ratio(n - 2.0, F.lit(1.0) - r * r))).alias("statistic"),
        (F.col("_n") - 2).alias("parameter"),
        F.tanh(F.atanh(r) - reach).alias("conf_low"),
        F.tanh(F.atanh(r) + reach).alias("conf_high"),
    )
    return out.withColumn("p_value", tails.t_p_value("statistic", "parameter")) if p_values else out


def _t_interval(out: DataFrame, alternative: str, level: float) -> DataFrame:
    """Confidence bounds from ``estimate``, ``_se`` and ``parameter``; one-sided tests have one bound."""
    infinite = F.lit(float("inf"))
    one_sided = alternative != "two.sided"
    reach = tails.t_critical(level if one_sided else 0.5 + level / 2, "parameter") * F.col("_se")
    out = out.withColumn("_reach", reach)
    low, high = F.col("estimate") - F.col("_reach"), F.col("estimate") + F.col("_reach")
    return out.withColumns(
        {
            "p_value": tails.t_p_value("statistic", "parameter", alternative),
            "conf_low": -infinite if alternative == "less" else low,
            "conf_high": infinite if alternative == "greater" else high,
        }
    ).drop("_reach")


def t_test_1(
    df: DataFrame, by: list[str], col: ColumnLike, alternative: str = "greater", mu: float = 0.0, level: float = 0.95, p_values: bool = True
) -> DataFrame:
    """One-sample t test of the group mean against ``mu``."""
    tails.check_alternative(alternative)
    v = finite(col)
    out = df.groupBy(*by).agg(
        F.avg(v).alias("estimate"), F.stddev_samp(v).alias("_sd"), F.count(v).alias("_n")
    )
    out = out.withColumn("_se", ratio("_sd", F.sqrt(F.col("_n").cast("double")))).select(
        *by,
        "estimate",
        ratio(F.col("estimate") - F.lit(mu), "_se").alias("statistic"),
        F.when(F.col("_n") > 1, F.col("_n") - 1).alias("parameter"),
        "_se",
    )
    return (_t_interval(out, alternative, level) if p_values else out).drop("_se")


def t_test_2(
    df: DataFrame, by: list[str], a: ColumnLike, b: ColumnLike, alternative: str = "two.sided", level: float = 0.95, p_values: bool = True
) -> DataFrame:
    """Welch test of mean(a) - mean(b) for two value columns; each column drops its own NULLs."""
    tails.check_alternative(alternative)
    va, vb = finite(a), finite(b)
    out = df.groupBy(*by).agg(
        F.avg(va).alias("estimate1"),
        F.avg(vb).alias("estimate2"),
        (F.var_samp(va) / F.nullif(F.count(va), F.lit(0))).alias("_qa"),
        (F.var_samp(vb) / F.nullif(F.count(vb), F.lit(0))).alias("_qb"),
        F.count(va).alias("_na"),
        F.count(vb).alias("_nb"),
    )
    qa, qb = F.col("_qa"), F.col("_qb")
    out = out.withColumn("_se", F.sqrt(qa + qb)).withColumn("estimate", F.col("estimate1") - F.col("estimate2"))
    out = out.select(
        *by,
        "estimate",
        "estimate1",
        "estimate2",
        ratio("estimate", "_se").alias("statistic"),
        ratio(
            (qa + qb) * (qa + qb), ratio(qa * qa, F.col("_na") - 1) + ratio(qb * qb, F.col("_nb") - 1)
        ).alias("parameter"),
        "_se",
    )
    return (_t_interval(out, alternative, level) if p_values else out).drop("_se")


def anova_1(df: DataFrame, by: list[str], y: ColumnLike, factor: str, p_values: bool = True) -> DataFrame:
    """One-way analysis of variance of y over the levels of a factor.

    Rows shrink to one line of moments per level before the group is put together.
    """
    v = finite(y)
    levels = df.where(v.isNotNull() & F.col(factor).isNotNull()).groupBy(*by, factor).agg(
        F.count(v).alias("_n"), F.avg(v).alias("_m"), (F.var_pop(v) * F.count(v)).alias("_within")
    )
    n, m = F.col("_n").cast("double"), F.col("_m")
    totals = levels.groupBy(*by).agg((F.sum(n * m) / F.sum(n)).alias("_grand"))
    out = join_on_group(levels, totals, by).groupBy(*by).agg(
        (F.count(F.lit(1)) - 1).alias("df"),
        (F.sum("_n") - F.count(F.lit(1))).alias("df_residual"),
        F.sum(n * (m - F.col("_grand")) * (m - F.col("_grand"))).alias("sumsq"),
        F.sum("_within").alias("sumsq_residual"),
    )
    out = out.withColumns(
        {"meansq": ratio("sumsq", "df"), "meansq_residual": ratio("sumsq_residual", "df_residual")}
    ).withColumn("statistic", ratio("meansq", "meansq_residual"))
    return out.withColumn("p_value", tails.f_p_value("statistic", "df", "df_residual")) if p_values else out


# --- rank-sum -----------------------------------------------------------------------------------


def _two_samples(df: DataFrame, by: list[str], a: ColumnLike, b: ColumnLike) -> DataFrame:
    """by, value, na, nb: how often each value occurs in either sample."""
    sides = df.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("first"), finite(a).alias("v")),
                F.struct(F.lit(False).alias("first"), finite(b).alias("v")),
            )
        ).alias("_s"),
    ).select(*by, F.col("_s.first").alias("first"), F.col("_s.v").alias("v"))
    return value_counts(sides, by, "v", na=F.count_if(F.col("first")), nb=F.count_if(~F.col("first")))


def _rank_sums(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, n_x, n_y, statistic, sigma, _ties from value counts (columns value, n, na, nb)."""
    n = F.col("n").cast("double")
    mid_rank = F.col("before") + (n + 1.0) / 2.0
    sums = running_counts(counts, by).groupBy(*by).agg(
        F.sum("na").alias("n_x"),
        F.sum("nb").alias("n_y"),
        F.sum(F.col("na") * mid_rank).alias("_ranks"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    nx, ny = F.col("n_x").cast("double"), F.col("n_y").cast("double")
    return sums.select(*by, "n_x", "n_y", (F.col("_ranks") - nx * (nx + 1.0) / 2.0).alias("statistic"), _sigma(nx, ny, F.col("_ties")).alias("sigma"), "_ties")


def _sigma(nx: Column, ny: Column, ties: Column) -> Column:
    """Standard deviation of the rank sum, with the sum of t^3 - t over ties of t rows."""
    total = nx + ny
    return F.sqrt(nx * ny / 12.0 * (total + 1.0 - ratio(ties, total * (total - 1.0))))


def _correction(z: Column, alternative: str) -> Column:
    return {"two.sided": F.signum(z) * 0.5, "greater": F.lit(0.5), "less": F.lit(-0.5)}[alternative]


# Both samples below this size, and no ties: the exact distribution is the default.
EXACT_BELOW = 50


def _exact(nx: Column, ny: Column, ties: Column, exact: bool | None) -> Column:
    if exact is not None:
        return F.lit(exact) & (ties == 0)
    return (nx < EXACT_BELOW) & (ny < EXACT_BELOW) & (ties == 0)


def rank_sum(
    df: DataFrame,
    by: list[str],
    a: ColumnLike,
    b: ColumnLike,
    alternative: str = "two.sided",
    ci: bool = False,
    level: float = 0.95,
    p_values: bool = True,
    exact: bool | None = None,
) -> DataFrame:
    """Wilcoxon rank-sum test of two value columns.

    Without ties and with both samples under 50 the exact null distribution is used, else the normal approximation with tie and
    continuity correction; ``exact`` asks for either (never exact with ties).  ``ci`` adds the location shift and its confidence
    bounds; see ``shift_estimates``.
    """
    tails.check_alternative(alternative)
    counts = computed_once(_two_samples(df, by, a, b))
    out = _rank_sums(counts, by)
    if p_values:
        centred = F.col("statistic") - F.col("n_x").cast("double") * F.col("n_y") / 2.0
        small = _exact(F.col("n_x"), F.col("n_y"), F.col("_ties"), exact)
        sizes = [F.when(small, F.col(c)) for c in ("n_x", "n_y")]
        z = ratio(centred - _correction(centred, alternative), "sigma")
        out = out.withColumn("p_value", F.coalesce(tails.rank_sum_p_value("statistic", *sizes, alternative), tails.z_p_value(z, alternative)))
    out = out.drop("sigma", "_ties")
    if ci:
        out = join_on_group(out, shift_estimates(counts, by, alternative, level, exact), by)
    return out


def shift_estimates(counts: DataFrame, by: list[str], alternative: str = "two.sided", level: float = 0.95, exact: bool | None = None) -> DataFrame:
    """estimate, conf_low, conf_high of the shift between two samples given as value counts (value, na, nb).

    With the normal approximation each is the largest shift at which the standardised rank sum is still above its quantile; with the
    exact distribution the estimate is the median difference and bounds come from its quantiles.  Either way they are order
    statistics of the differences, so only their ranks are computed here.  Ties inside a sample count for the variance; those between samples
    depend on the shift and vanish beside it.
    """
    tails.check_alternative(alternative)
    if not by:
        whole = counts.withColumn("_all", F.lit(True))
        return shift_estimates(whole, ["_all"], alternative, level, exact).drop("_all")
    one_sided = alternative != "two.sided"
    tail = 1 - level if one_sided else (1 - level) / 2
    z = -tails.normal_quantile(tail)
    cube = lambda c: F.sum(F.pow(F.col(c).cast("double"), F.lit(3.0)) - F.col(c))
    sums = counts.groupBy(*by).agg(
        F.sum("na").alias("_nx"), F.sum("nb").alias("_ny"), (cube("na") + cube("nb")).alias("_within"), cube("n").alias("_ties")
    ).where("_nx > 0 and _ny > 0")
    nx, ny = F.col("_nx").cast("double"), F.col("_ny").cast("double")
    sums = sums.withColumn("_exact", _exact(F.col("_nx"), F.col("_ny"), F.col("_ties"), exact))
    sums = sums.withColumns({"_pairs": F.col("_nx") * F.col("_ny"), "_reach": F.lit(z) * _sigma(nx, ny, F.col("_within")) + 0.5})
    sizes = [F.when(F.col("_exact"), F.col(c)) for c in ("_nx", "_ny")]
    sums = sums.withColumn("_q", F.greatest(F.lit(1), tails.rank_sum_quantile(tail, *sizes).cast("bigint")))
    # As many differences lie above the one sought as the count at the crossing; the rank is one more.
    half = F.col("_pairs") / 2.0
    under = lambda count: (F.floor(count) + 1).cast("bigint")
    chosen = {
        # The median of an even number of differences is the mean of two.
        "estimate": F.when(F.col("_exact"), F.floor((F.col("_pairs") + 2) / 2).cast("bigint")).otherwise(under(half)),
        "estimate_too": F.when(F.col("_exact"), F.floor((F.col("_pairs") + 1) / 2).cast("bigint")).otherwise(under(half)),
    }
    if alternative != "less":
        chosen["conf_low"] = F.when(F.col("_exact"), F.col("_pairs") + 1 - F.col("_q")).otherwise(under(half + F.col("_reach")))
    if alternative != "greater":
        chosen["conf_high"] = F.when(F.col("_exact"), F.col("_q")).otherwise(under(half - F.col("_reach")))
    ranks = sums.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("root"), rank.alias("rank")) for name, rank in chosen.items()])).alias("_r")).select(*by, "_r.*")
    found = ranked_differences(counts, by, computed_once(ranks))
    out = found.groupBy(*by).agg(*[F.max(F.when(F.col("root") == name, F.col("shift"))).alias(name) for name in chosen])
    out = out.withColumn("estimate", (F.col("estimate") + F.col("estimate_too")) / 2.0).drop("estimate_too")
    infinite = F.lit(float("inf"))
    if alternative == "greater":
        out = out.withColumn("conf_high", infinite)
    if alternative == "less":
        out = out.withColumn("conf_low", -infinite)
    return out
