"""Random-intercept models y ~ x + (1 | group), fitted exactly from sufficient statistics.

For a variance ratio r = (between-group variance) / (residual variance), a group of n rows enters the
likelihood through weight n / (1 + r n), its mean of x and y, and its inner sums of squares.  Groups
of equal size share the weight, so their sums can be added up.  One cell therefore needs one row per
*distinct group size*: with N rows there are fewer than sqrt(2 N) of those, whatever the number of
groups.  Spark does both reductions with map-side combining, and the one-dimensional search over r
runs on the remaining rows of each cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.functions import tails
from clozeframe.functions.measures import ColumnLike, finite
from clozeframe.operators.joins import join_on_group

SIZE_CLASS_COLUMNS = ["size", "groups", "mx", "my", "bxx", "bxy", "byy", "wxx", "wxy", "wyy"]


def size_classes(df: DataFrame, by: list[str], y: ColumnLike, x: ColumnLike, group: str) -> DataFrame:
    """Sufficient statistics: one row per cell and distinct group size.

    groups: how many groups have that size; mx, my: mean of the group means; bxx, bxy, byy: squares
    and products of group means around mx, my; wxx, wxy, wyy: the same of rows around group means.
    """
    rows = df.select(*by, F.col(group).alias("_g"), finite(y).alias("_y"), finite(x).alias("_x"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_y").isNotNull() & F.col("_x").isNotNull())
    per_group = rows.groupBy(*by, "_g").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("_x").alias("_mx"),
        F.avg("_y").alias("_my"),
        F.regr_sxx("_y", "_x").alias("_wxx"),
        F.regr_sxy("_y", "_x").alias("_wxy"),
        F.regr_syy("_y", "_x").alias("_wyy"),
    )
    return per_group.groupBy(*by, "size").agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("_mx").alias("mx"),
        F.avg("_my").alias("my"),
        F.regr_sxx("_my", "_mx").alias("bxx"),
        F.regr_sxy("_my", "_mx").alias("bxy"),
        F.regr_syy("_my", "_mx").alias("byy"),
        F.sum("_wxx").alias("wxx"),
        F.sum("_wxy").alias("wxy"),
        F.sum("_wyy").alias("wyy"),
    )


def deviance_at(classes: DataFrame, by: list[str], ratios: list[float]) -> DataFrame:
    """ML deviance and coefficients at given variance ratios, as plain aggregates of the size classes."""
    c = F.col
    n = c("size").cast("double")
    m = c("groups").cast("double")
    centre = classes.groupBy(*by).agg(
        (F.sum(m * n * c("mx")) / F.sum(m * n)).alias("_cx"),
        (F.sum(m * n * c("my")) / F.sum(m * n)).alias("_cy"),
    )
    at = join_on_group(classes, centre, by).withColumn(
        "ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios]))
    )
    h = n / (F.lit(1.0) + c("ratio") * n)
    dx, dy = c("mx") - c("_cx"), c("my") - c("_cy")
    sums = at.groupBy(*by, "ratio").agg(
        F.sum(m * n).alias("_n"),
        F.sum(m * F.log1p(c("ratio") * n)).alias("_logs"),
        F.sum(h * m).alias("_a"),
        F.sum(h * m * dx).alias("_b"),
        F.sum(c("wxx") + h * (c("bxx") + m * dx * dx)).alias("_d"),
        F.sum(h * m * dy).alias("_u"),
        F.sum(c("wxy") + h * (c("bxy") + m * dx * dy)).alias("_v"),
        F.sum(c("wyy") + h * (c("byy") + m * dy * dy)).alias("_q"),
        F.max("_cx").alias("_cx"),
        F.max("_cy").alias("_cy"),
    )
    det = c("_a") * c("_d") - c("_b") * c("_b")
    slope = (c("_a") * c("_v") - c("_b") * c("_u")) / F.nullif(det, F.lit(0.0))
    solved = sums.withColumn("slope", slope).withColumn("_b0", (c("_u") - c("_b") * c("slope")) / c("_a"))
    rss = c("_q") - c("_b0") * c("_u") - c("slope") * c("_v")
    return solved.select(
        *by,
        "ratio",
        "slope",
        (c("_b0") + c("_cy") - c("slope") * c("_cx")).alias("intercept"),
        (c("_n") * (F.ln(F.lit(2 * math.pi) * rss / c("_n")) + 1.0) + c("_logs")).alias("deviance"),
    )


# Logarithms of the ratios searched first, and the sections and rounds of the search between two of them.
LOG_RATIOS = np.linspace(math.log(1e-8), math.log(1e8), 129)
SECTIONS, ROUNDS = 16, 12
# A residual below this share of the total is a perfect fit, and deviances closer than this are equal.
PERFECT, EQUAL = 1e-10, 1e-9


class _Cell:
    """Likelihood of one cell as a function of the variance ratio (small arrays only).

    All functions of the ratio take an array of ratios.  A group of n rows has weight h = n / (1 + r n), whose derivatives by r
    are -h^2 and 2 h^3, so sums, residuals and determinant have closed first and second derivatives.
    """

    def __init__(self, pdf: pd.DataFrame, with_slope: bool, reml: bool):
        f = {k: pdf[k].to_numpy(float) for k in SIZE_CLASS_COLUMNS}
        self.n, self.m = f["size"], f["groups"]
        rows = self.m * self.n
        self.total = rows.sum()
        self.cx, self.cy = (rows * f["mx"]).sum() / self.total, (rows * f["my"]).sum() / self.total
        dx, dy = f["mx"] - self.cx, f["my"] - self.cy
        # By size class: the parts of the sums a, b, d (x by x), u, v (x by y) and q (y by y) that are weighted, and what is not.
        self.between = np.stack(
            [self.m, self.m * dx, f["bxx"] + self.m * dx * dx, self.m * dy, f["bxy"] + self.m * dx * dy, f["byy"] + self.m * dy * dy]
        )
        self.within = np.array([0.0, 0.0, f["wxx"].sum(), 0.0, f["wxy"].sum(), f["wyy"].sum()])
        # A constant predictor leaves the slope undefined.
        sxx = self.within[2] + (self.n * self.between[2]).sum()
        self.with_slope = with_slope and sxx > 1e-12 * max(1.0, self.total * self.cx**2)
        self.reml = reml
        self.p = 2 if self.with_slope else 1
        self.freedom = self.total - self.p if reml else self.total
        # With one row per group only the sum of both variances is known; see also ``fit``.
        self.identified = bool((self.n > 1).any())

    def _weights(self, r: np.ndarray) -> np.ndarray:
        return self.n / (1.0 + np.atleast_1d(r)[:, None] * self.n)

    def solve(self, r: np.ndarray):
        """Coefficients (centred, as columns), residual sum of squares and sums at each ratio."""
        sums = self.within[:, None] + self.between @ self._weights(r).T
        a, b, d, u, v, q = sums
        if self.with_slope:
            slope = (a * v - b * u) / (a * d - b * b)
            beta = np.stack([(u - b * slope) / a, slope])
        else:
            beta = np.stack([u / a, np.zeros_like(a)])
        return beta, np.maximum(q - beta[0] * u - beta[1] * v, 0.0), sums

    def _determinant(self, sums: np.ndarray) -> np.ndarray:
        return sums[0] * sums[2] - sums[1] ** 2 if self.with_slope else sums[0]

    def deviance(self, r: np.ndarray) -> np.ndarray:
        _, rss, sums = self.solve(r)
        logs = (self.m * np.log1p(np.atleast_1d(r)[:, None] * self.n)).sum(axis=1)
        with np.errstate(divide="ignore"):
            out = self.freedom * (np.log(2 * math.pi * rss / self.freedom) + 1.0) + logs
        return out + (np.log(self._determinant(sums)) if self.reml else 0.0)

    def _residual_slope(self, beta: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """Change of the residual sum of squares when the sums change; the coefficients are at their best."""
        a, b, d, u, v, q = moved
        return q - 2 * (beta[0] * u + beta[1] * v) + beta[0] ** 2 * a + 2 * beta[0] * beta[1] * b + beta[1] ** 2 * d

    def slope_of_deviance(self, r: np.ndarray) -> np.ndarray:
        beta, rss, sums = self.solve(r)
        h = self._weights(r)
        moved = self.between @ -(h.T**2)
        out = self.freedom * self._residual_slope(beta, moved) / rss + (self.m * h).sum(axis=1)
        if not self.reml:
            return out
        if not self.with_slope:
            return out + moved[0] / sums[0]
        return out + (moved[0] * sums[2] + sums[0] * moved[2] - 2 * sums[1] * moved[1]) / self._determinant(sums)

    def fit(self) -> float | None:
        """Variance ratio with the lowest deviance, 0 included; None if a ratio leaves no residual or none is large enough.

        If the deviance is the same for all ratios the variances cannot be told apart, and plain regression (0) is taken.  The best of a grid has the minimum beside it; sections there are cut where the deviance stops falling.
        """
        if self.freedom <= 0:
            return None
        values = self.deviance(np.exp(LOG_RATIOS))
        self.identified = self.identified and not values.max() - values.min() <= EQUAL
        if not self.identified:
            return None if self.perfect(0.0) else 0.0
        i = int(values.argmin())
        lo, hi = LOG_RATIOS[max(i - 1, 0)], LOG_RATIOS[min(i + 1, len(LOG_RATIOS) - 1)]
        if values[-1] <= values[i] + EQUAL or self.perfect(math.exp(LOG_RATIOS[i])):
            return None
        for _ in range(ROUNDS):
            cuts = lo + (hi - lo) * np.arange(SECTIONS + 1) / SECTIONS
            rising = np.flatnonzero(self.slope_of_deviance(np.exp(cuts[1:-1])) >= 0)
            k = int(rising[0]) if len(rising) else SECTIONS - 1
            lo, hi = cuts[k], cuts[k + 1]
        best = math.exp(0.5 * (lo + hi))
        best = 0.0 if self.deviance(0.0)[0] <= self.deviance(best)[0] else best
        return None if self.perfect(best) else best

    def perfect(self, r: float) -> bool:
        _, rss, sums = self.solve(r)
        return bool(rss[0] <= PERFECT * sums[5][0])

    def coefficients(self, r: float | None) -> tuple[float | None, float]:
        """Slope (None without one) and intercept; for a cell without residual those at the largest ratio."""
        beta = self.solve(math.exp(LOG_RATIOS[-1]) if r is None else r)[0][:, 0]
        return (float(beta[1]) if self.with_slope else None), float(beta[0] + self.cy - beta[1] * self.cx)

    def satterthwaite(self, r: float, s: float) -> list[float | None]:
        """Degrees of freedom of each coefficient, from the curvature of the restricted deviance in (ratio, residual variance).

        At ratio 0 only the residual variance is free, and they are rows less coefficients.  They are None where the curvature is not
        that of a minimum.
        """
        beta, rss, sums = (x[..., 0] for x in self.solve(r))
        h = self._weights(r)[0]
        p = self.p
        gram = np.array([[sums[0], sums[1]], [sums[1], sums[2]]])[:p, :p]
        first, second = self.between @ -(h**2), self.between @ (2 * h**3)
        matrix = lambda x: np.array([[x[0], x[1]], [x[1], x[2]]])[:p, :p]
        g1, g2, c1, b = matrix(first), matrix(second), first[3:5][:p], beta[:p]
        inverse = np.linalg.inv(gram)
        spread = inverse @ g1 @ inverse
        values = np.diag(inverse) * s
        if r == 0.0:
            return [float(self.freedom)] * p
        # Coefficients move by inverse (c1 - g1 b) when the ratio does.
        pull = c1 - g1 @ b
        rss1 = self._residual_slope(beta, first)
        rss2 = self._residual_slope(beta, second) - 2 * pull @ inverse @ pull
        turn = np.trace(inverse @ g2) - np.trace(spread @ g1)
        rr = -(self.m * h**2).sum() + rss2 / s + turn
        rs, ss = -rss1 / s**2, -self.freedom / s**2 + 2 * rss / s**3
        det = rr * ss - rs * rs
        if not (rr > 0 and det > 1e-12 * rr * ss):
            return [None] * p
        by_r, by_s = -np.diag(spread) * s, np.diag(inverse)
        variance = 2 * (ss * by_r**2 - 2 * rs * by_r * by_s + rr * by_s**2) / det
        return [float(2 * v * v / w) for v, w in zip(values, variance, strict=True)]


def _per_cell(classes: DataFrame, by: list[str], out: str, fn) -> DataFrame:
    """Apply ``fn(pdf) -> list of dicts`` to the size classes of each cell."""
    keys = ", ".join(f"`{k}` {classes.schema[k].dataType.simpleString()}" for k in by)
    names = [part.strip().split()[0] for part in out.split(",")]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in by}
        return pd.DataFrame([head | row for row in fn(pdf)], columns=[*by, *names])

    return classes.groupBy(*by).applyInPandas(solve, f"{keys}, {out}" if by else out)


_ML = (
    "slope double, intercept double, ratio double, sigma2 double, tau2 double, logLik double, "
    "deviance double, nobs bigint, groups bigint"
)


def lmm_ml(
    df: DataFrame, by: list[str], y: ColumnLike, x: ColumnLike, group: str, with_slope: bool = True
) -> DataFrame:
    """Maximum-likelihood fit per cell; ``with_slope=False`` fits the intercept only.

    A cell without residual (also one whose groups are each fitted exactly) has coefficients, but no variances and no
    likelihood.  With one row per group the variances are NULL, as they cannot be told apart.
    """

    def fit(pdf: pd.DataFrame) -> list[dict]:
        cell = _Cell(pdf, with_slope, reml=False)
        r = cell.fit()
        slope, intercept = cell.coefficients(r)
        out = {"slope": slope, "intercept": intercept, "nobs": int(cell.total), "groups": int(cell.m.sum())}
        if r is None:
            return [out]
        if cell.identified:
            s = float(cell.solve(r)[1][0]) / cell.total
            out |= {"ratio": r, "sigma2": s, "tau2": r * s}
        dev = float(cell.deviance(r)[0])
        return [out | {"logLik": -dev / 2.0, "deviance": dev}]

    return _per_cell(size_classes(df, by, y, x, group), by, _ML, fit)


def lmm_lrt(df: DataFrame, by: list[str], y: ColumnLike, x: ColumnLike, group: str) -> DataFrame:
    """Likelihood-ratio test of the slope against the intercept-only model, both by ML.

    Statistic and p-value are NULL for a constant predictor and where a model leaves no residual.
    """

    def test(pdf: pd.DataFrame) -> list[dict]:
        full, null = _Cell(pdf, True, reml=False), _Cell(pdf, False, reml=False)
        if not full.with_slope:
            return [{"df": 1}]
        r, r0 = full.fit(), null.fit()
        out = {"df": 1, "fixed_effect": full.coefficients(r)[0]}
        if r is None or r0 is None:
            return [out]
        statistic = max(0.0, float(null.deviance(r0)[0] - full.deviance(r)[0]))
        return [out | {"statistic": statistic, "p_value": tails.chi2_upper_1df(statistic)}]

    out = "statistic double, df int, p_value double, fixed_effect double"
    return _per_cell(size_classes(df, by, y, x, group), by, out, test)


def lmm_reml(df: DataFrame, by: list[str], y: ColumnLike, x: ColumnLike, group: str) -> DataFrame:
    """Restricted-likelihood fit with x centred on its cell mean: one row per coefficient.

    Degrees of freedom follow Satterthwaite; p-values are two-sided t tests.  A constant predictor has no slope row.  A cell
    without residual, or with no more rows than coefficients, has estimates only; where the curvature is not that of a minimum, degrees
    of freedom and p-value are NULL.
    """

    def table(pdf: pd.DataFrame) -> list[dict]:
        cell = _Cell(pdf, True, reml=True)
        r = cell.fit()
        slope, intercept = cell.coefficients(r)
        rows = [{"term": "intercept", "estimate": intercept + (slope or 0.0) * cell.cx}]
        if cell.with_slope:
            rows.append({"term": "slope", "estimate": slope})
        if r is None:
            return rows
        _, rss, sums = cell.solve(r)
        s = float(rss[0]) / cell.freedom
        a, _, d = sums[:3, 0]
        det = float(cell._determinant(sums)[0])
        variances = [d / det * s, a / det * s] if cell.with_slope else [s / a]
        for row, v, freedom in zip(rows, variances, cell.satterthwaite(r, s), strict=True):
            t = row["estimate"] / math.sqrt(v)
            row |= {"std_error": math.sqrt(v), "statistic": t, "df": freedom}
            if freedom is not None:
                row["p_value"] = min(1.0, 2.0 * tails.t_upper(abs(t), freedom))
        return rows

    out = "term string, estimate double, std_error double, df double, statistic double, p_value double"
    return _per_cell(size_classes(df, by, y, x, group), by, out, table)
