"""Tests and models against brute force in NumPy, and known tail values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clozeframe.functions import tails
from clozeframe.operators import mixed, ordered, shift, stats


def test_tail_values():
    # Table values: t(0.975), F(0.95), normal quantile.
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert tails.t_quantile(0.05, 3) == pytest.approx(-2.353363435, abs=1e-8)
    assert tails.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_upper(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    # Cauchy and closed two-degree forms, far into the tail.
    for t in (0.3, 5.0, 1e6):
        assert tails.t_upper(t, 1) == pytest.approx(math.atan2(1, t) / math.pi, rel=1e-10)
        assert tails.f_upper(t, 2, 8) == pytest.approx((1 + t / 4) ** -4, rel=1e-10)


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def dense_ranks(values):
    order = np.sort(values)
    left, right = np.searchsorted(order, values, "left"), np.searchsorted(order, values, "right")
    return (left + right + 1) / 2.0


def rank_statistic(x, y):
    ranks = dense_ranks(np.concatenate([x, y]))
    n, m = len(x), len(y)
    w = ranks[:n].sum() - n * (n + 1) / 2
    _, ties = np.unique(np.concatenate([x, y]), return_counts=True)
    total = n + m
    sigma = math.sqrt(n * m / 12 * (total + 1 - (ties**3 - ties).sum() / (total * (total - 1))))
    return w, w - n * m / 2, sigma


def test_running_counts_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=300), np.full(400, 0.25), rng.exponential(1e-9, 50), -np.exp(rng.normal(0, 9, 80)), [0.0, -0.0]])
    df = frame(spark, g=["a"] * len(x), x=x)
    out = ordered.running_counts(ordered.value_counts(df, ["g"], "x"), ["g"]).collect()
    assert len(out) == len(np.unique(x + 0.0))
    for r in out:
        assert (r.before, r.n) == ((x < r.value).sum(), (x == r.value).sum())


def test_quantiles_brute_force(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, g=np.repeat(["a", "b", "c"], [101, 40, 1]), x=np.round(rng.normal(size=142), 1))
    out = ordered.quantiles(df, ["g"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.975}).collect()
    pdf = df.toPandas()
    for r in out:
        assert [r.lo, r.mid, r.hi] == pytest.approx(np.quantile(pdf[pdf.g == r.g].x, [0.1, 0.5, 0.975]))


def test_box_stats(spark):
    x = [0.0, 1.0, 2.0, 3.0, 4.0, 100.0]
    row = ordered.box_stats(frame(spark, x=x), [], "x").first()
    assert (row.n, row.min, row.q1, row.median, row.q3, row.max) == (6, 0.0, 1.25, 2.5, 3.75, 100.0)
    assert (row.whisker_low, row.whisker_high) == (0.0, 4.0)


def test_density_near_exact_kernel_sum(spark):
    x = np.random.default_rng(3).normal(size=400)
    out = ordered.density(frame(spark, g=["a"] * 400, x=x), ["g"], "x").toPandas().sort_values("point")
    bw = 0.9 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * 400**-0.2
    exact = np.exp(-0.5 * ((out.x.to_numpy()[:, None] - x) / bw) ** 2).sum(axis=1) / (400 * bw * math.sqrt(2 * math.pi))
    assert out.bw.iloc[0] == pytest.approx(bw)
    assert np.abs(out.density - exact).max() < 1e-3
    assert np.trapezoid(out.density, out.x) == pytest.approx(1.0, abs=5e-3)


def test_rank_sum_brute_force(spark):
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(0.3, 1, 200), 1), np.round(rng.normal(0, 1, 200), 1)
    df = frame(spark, g=["a"] * 200, x=x, y=y)
    w, centred, sigma = rank_statistic(x, y)
    for alternative, shift in (("two.sided", math.copysign(0.5, centred)), ("greater", 0.5), ("less", -0.5)):
        row = stats.rank_sum(df, ["g"], "x", "y", alternative).first()
        z = (centred - shift) / sigma
        upper = tails.normal_upper(z)
        want = {"two.sided": 2 * tails.normal_upper(abs(z)), "greater": upper, "less": 1 - upper}[alternative]
        assert row.statistic == w and row.p_value == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("alternative", ["two.sided", "greater", "less"])
def test_shift_interval_brute_force(spark, alternative):
    rng = np.random.default_rng(5)
    x, y = rng.normal(0.5, 1, 60), rng.normal(0, 1, 60)
    by = ["g"] if alternative == "two.sided" else []
    row = stats.rank_sum(frame(spark, g=["a"] * 60, x=x, y=y), by, "x", "y", alternative, ci=True).first()

    def crossing(quantile, fixed):
        lo, hi = x.min() - y.max(), x.max() - y.min()
        while hi - lo > 1e-7:
            mid = (lo + hi) / 2
            _, dz, sigma = rank_statistic(x - mid, y)
            c = np.sign(dz) * 0.5 if fixed is None else fixed
            lo, hi = (mid, hi) if (dz - c) / sigma > quantile else (lo, mid)
        return lo

    z = tails.normal_quantile(0.975 if alternative == "two.sided" else 0.95)
    fixed = {"two.sided": None, "greater": 0.5, "less": -0.5}[alternative]
    assert row.estimate == pytest.approx(crossing(0.0, 0.0), abs=1e-6)
    assert row.estimate == pytest.approx(np.median(np.subtract.outer(x, y)), abs=2e-2)
    assert row.conf_low == (-math.inf if alternative == "less" else pytest.approx(crossing(z, fixed), abs=1e-6))
    assert row.conf_high == (math.inf if alternative == "greater" else pytest.approx(crossing(-z, fixed), abs=1e-6))
    differences = set(np.subtract.outer(x, y).ravel())
    assert {row.estimate, row.conf_low, row.conf_high} - {math.inf, -math.inf} <= differences


@pytest.mark.parametrize("listed, bins", [(1_000_000, 512), (40, 8), (1, 2)])
def test_ranked_differences_brute_force(spark, monkeypatch, listed, bins):
    """Continuous values, heavy ties and equal differences, in several rounds where few pairs may be listed."""
    monkeypatch.setattr(shift, "LISTED", listed)
    monkeypatch.setattr(shift, "LEAST_BINS", bins)
    rng = np.random.default_rng(8)
    groups = {
        "smooth": (rng.normal(size=300), rng.normal(1, 2, 200)),
        "ties": (rng.integers(0, 12, 300) / 12, rng.integers(0, 5, 150) / 5),
        "near one": (1 - 1e-9 * rng.random(200), np.append(1 - 1e-9 * rng.random(200), 1.0005)),
        "single": (np.array([2.0]), np.array([0.5])),
    }
    rows, ranks, want = [], [], {}
    for g, (x, y) in groups.items():
        rows += [(g, float(v), None) for v in x] + [(g, None, float(v)) for v in y]
        ordered_down = np.sort(np.subtract.outer(x, y).ravel())[::-1]
        for k in (1, len(ordered_down) // 3, len(ordered_down) // 2 + 1, len(ordered_down)):
            k = max(k, 1)
            ranks.append((g, f"r{k}", k))
            want[g, f"r{k}"] = ordered_down[k - 1]
    counts = stats._two_samples(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y")
    out = shift.ranked_differences(counts, ["g"], spark.createDataFrame(sorted(set(ranks)), "g string, root string, rank bigint"))
    assert {(r.g, r.root): r["shift"] for r in out.collect()} == want


def enumerated(x, y):
    """How often each statistic occurs over all ways to deal the values to samples of these sizes."""
    from itertools import combinations

    both = np.sort(np.concatenate([x, y]))
    out = []
    for chosen in combinations(range(len(both)), len(x)):
        out.append(sum(chosen) + len(x) - len(x) * (len(x) + 1) // 2)
    return np.array(out)


@pytest.mark.parametrize("m, n", [(1, 4), (5, 4), (6, 7)])
def test_small_samples_are_exact(spark, m, n):
    rng = np.random.default_rng(m)
    x, y = rng.normal(0.4, 1, m), rng.normal(0, 1, n)
    rows = [("a", float(v), None) for v in x] + [("a", None, float(v)) for v in y]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    w = float((x[:, None] > y).sum())
    every = enumerated(x, y)
    upper, lower = (every >= w).mean(), (every <= w).mean()
    want = {"two.sided": min(1.0, 2 * (upper if w > m * n / 2 else lower)), "greater": upper, "less": lower}
    differences = np.sort(np.subtract.outer(x, y).ravel())
    for alternative, p in want.items():
        row = stats.rank_sum(df, ["g"], "x", "y", alternative, ci=True).first()
        assert (row.statistic, row.p_value) == (w, pytest.approx(p, rel=1e-12))
        assert row.estimate == pytest.approx(np.median(differences))
        q = max(1, next(k for k in range(m * n + 1) if (every <= k).mean() >= (0.025 if alternative == "two.sided" else 0.05) * (1 - 1e-12)))
        assert row.conf_low == (-math.inf if alternative == "less" else differences[q - 1])
        assert row.conf_high == (math.inf if alternative == "greater" else differences[m * n - q])
    # With a tie, or when asked, the normal approximation is used.
    normal = stats.rank_sum(df, ["g"], "x", "y", "greater", exact=False).first().p_value
    assert normal != pytest.approx(upper, rel=1e-6)


def test_regression_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=50)
    y = 2 + 0.5 * x + rng.normal(size=50)
    df = frame(spark, x=x, y=y)
    row = stats.lm_glance(df, [], "y", "x").first()
    slope, intercept = np.polyfit(x, y, 1)
    rss = ((y - intercept - slope * x) ** 2).sum()
    assert (row.slope, row.intercept, row.deviance) == pytest.approx((slope, intercept, rss))
    assert row.statistic == pytest.approx((((y - y.mean()) ** 2).sum() - rss) / (rss / 48))
    assert row.logLik == pytest.approx(-25 * (math.log(2 * math.pi * rss / 50) + 1))
    scaled = stats.lm_glance(df, [], "y", "x", scale_x=True).first()
    assert scaled.slope == pytest.approx(slope * x.std(ddof=1)) and scaled.intercept == pytest.approx(y.mean())
    # Slope t test and correlation test agree.
    cor = stats.cor_test(df, [], "x", "y").first()
    assert cor.p_value == pytest.approx(row.p_value) and cor.statistic**2 == pytest.approx(row.statistic)
    band = stats.fit_band(df, [], "y", "x", grid=3).orderBy("point").collect()
    assert band[0].x == x.min() and band[2].x == pytest.approx(x.max())
    reach = tails.t_quantile(0.975, 48) * math.sqrt(rss / 48 * (1 / 50 + (x.min() - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
    assert band[0].upper - band[0].fit == pytest.approx(reach)


def test_constant_predictor_and_tiny_groups(spark):
    df = spark.createDataFrame(
        [("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 4.0), ("one", 1.0, 2.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0)],
        "g string, x double, y double",
    )
    out = {r.g: r for r in stats.lm_glance(df, ["g"], "y", "x").collect()}
    assert out["flat"].slope is None and out["flat"].p_value is None and out["one"].slope is None
    assert out["line"].slope == 1.0 and out["line"].sigma is None
    assert stats.fit_band(df, ["g"], "y", "x", grid=2).count() == 6
    t = {r.g: r for r in stats.t_test_1(df, ["g"], "y").collect()}
    assert t["one"].statistic is None and t["one"].p_value is None


def test_welch_and_anova(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(1, 1, 30), rng.normal(0, 2, 30)
    row = stats.t_test_2(frame(spark, a=a, b=b), [], "a", "b", "greater").first()
    qa, qb = a.var(ddof=1) / 30, b.var(ddof=1) / 30
    df = (qa + qb) ** 2 / (qa**2 / 29 + qb**2 / 29)
    t = (a.mean() - b.mean()) / math.sqrt(qa + qb)
    assert (row.statistic, row.parameter) == pytest.approx((t, df))
    assert row.p_value == pytest.approx(tails.t_upper(t, df)) and row.conf_high == math.inf
    assert row.conf_low == pytest.approx(a.mean() - b.mean() - tails.t_quantile(0.95, df) * math.sqrt(qa + qb))
    both = frame(spark, y=np.concatenate([a, b]), k=["a"] * 30 + ["b"] * 30)
    f = stats.anova_1(both, [], "y", "k").first()
    pooled = (a.var(ddof=1) + b.var(ddof=1)) / 2
    assert f.statistic == pytest.approx((a.mean() - b.mean()) ** 2 / (pooled * 2 / 30))
    assert (f.df, f.df_residual) == (1, 58)


# --- mixed models ---------------------------------------------------------------------------------


def simulated(seed, tau, groups=60, slope=-1.5):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, groups)
    g = np.repeat(np.arange(groups), sizes)
    x = rng.uniform(0, 1, len(g)) + 5
    y = 3 + slope * x + tau * rng.normal(size=groups)[g] + rng.normal(size=len(g))
    return g, x, y


def dense_deviance(g, x, y, r, with_slope=True, reml=False):
    """Deviance from the full covariance matrix."""
    v = np.eye(len(y)) + r * (g[:, None] == g[None, :])
    design = np.column_stack([np.ones(len(y)), x - x.mean()] if with_slope else [np.ones(len(y))])
    vi = np.linalg.inv(v)
    xtx = design.T @ vi @ design
    beta = np.linalg.solve(xtx, design.T @ vi @ y)
    e = y - design @ beta
    rss = e @ vi @ e
    n = len(y) - design.shape[1] if reml else len(y)
    dev = n * (math.log(2 * math.pi * rss / n) + 1) + np.linalg.slogdet(v)[1]
    return dev + (np.linalg.slogdet(xtx)[1] if reml else 0.0), beta, rss / n, np.linalg.inv(xtx) * rss / n


def cells(spark):
    data = {"wide": simulated(1, 1.2), "none": simulated(2, 0.0), "some": simulated(3, 0.4)}
    pdf = pd.concat(pd.DataFrame({"cell": k, "g": g, "x": x, "y": y}) for k, (g, x, y) in data.items())
    return data, spark.createDataFrame(pdf)


def test_fixed_ratio_deviance_is_exact(spark):
    data, df = cells(spark)
    classes = mixed.size_classes(df, ["cell"], "y", "x", "g")
    for r in mixed.deviance_at(classes, ["cell"], [0.0, 0.1, 1.0, 7.0]).collect():
        dev, beta, _, _ = dense_deviance(*data[r.cell], r.ratio)
        assert r.deviance == pytest.approx(dev, rel=1e-10) and r.slope == pytest.approx(beta[1], rel=1e-9)


def test_ml_fit_is_the_lowest_dense_deviance(spark):
    data, df = cells(spark)
    for r in mixed.lmm_ml(df, ["cell"], "y", "x", "g").collect():
        g, x, y = data[r.cell]
        dev, beta, s, _ = dense_deviance(g, x, y, r.ratio)
        assert r.deviance == pytest.approx(dev, rel=1e-10)
        assert (r.slope, r.sigma2) == pytest.approx((beta[1], s), rel=1e-8)
        assert r.intercept == pytest.approx(beta[0] - beta[1] * x.mean(), rel=1e-8)
        assert min(dense_deviance(g, x, y, t)[0] for t in [0.0, *np.geomspace(1e-3, 1e2, 40)]) >= r.deviance - 1e-8
        assert (r.nobs, r.groups) == (len(y), len(set(g)))


def test_likelihood_ratio(spark):
    data, df = cells(spark)
    for r in mixed.lmm_lrt(df, ["cell"], "y", "x", "g").collect():
        grid = [0.0, *np.geomspace(1e-3, 1e2, 300)]
        full, null = (min(dense_deviance(*data[r.cell], t, s)[0] for t in grid) for s in (True, False))
        assert r.statistic == pytest.approx(null - full, abs=5e-3) and r.df == 1
        assert r.p_value == pytest.approx(math.erfc(math.sqrt(r.statistic / 2)), rel=1e-9)


def test_reml_table(spark):
    data, df = cells(spark)
    out = {(r.cell, r.term): r for r in mixed.lmm_reml(df, ["cell"], "y", "x", "g").collect()}
    for cell, (g, x, y) in data.items():
        grid = [0.0, *np.geomspace(1e-4, 1e2, 400)]
        best = min(grid, key=lambda t: dense_deviance(g, x, y, t, reml=True)[0])
        _, beta, _, cov = dense_deviance(g, x, y, best, reml=True)
        for i, term in enumerate(("intercept", "slope")):
            r = out[cell, term]
            assert r.estimate == pytest.approx(beta[i], rel=2e-3)
            assert r.std_error == pytest.approx(math.sqrt(cov[i, i]), rel=2e-2)
            assert r.p_value == pytest.approx(2 * tails.t_upper(abs(r.statistic), r.df), rel=1e-9)
    # Without variance between groups the model is plain regression.
    n = len(data["none"][0])
    if out["none", "slope"].df > n - 3:
        assert out["none", "slope"].df == pytest.approx(n - 2, rel=1e-3)
    # A balanced one-way layout has groups - 1 degrees of freedom for the intercept.
    rng = np.random.default_rng(9)
    g = np.repeat(np.arange(20), 6)
    x = np.tile(np.arange(6.0), 20)
    y = 2 * rng.normal(size=20)[g] + 0.3 * x + rng.normal(size=120)
    balanced = {r.term: r for r in mixed.lmm_reml(spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y})), [], "y", "x", "g").collect()}
    assert balanced["intercept"].df == pytest.approx(19, rel=1e-3)
    assert balanced["slope"].df == pytest.approx(120 - 20 - 1, rel=1e-3)


def test_constant_predictor_has_no_test(spark):
    df = spark.createDataFrame([(i % 5, 2.0, float(i * i % 7)) for i in range(30)], "g int, x double, y double")
    row = mixed.lmm_lrt(df.withColumn("cell", F.lit(1)), ["cell"], "y", "x", "g").first()
    assert row.statistic is None and row.p_value is None


def test_cells_without_an_ordinary_fit(spark):
    """A perfect line, groups that are each constant, one row per group, too few rows, and a flat likelihood."""
    rng = np.random.default_rng(11)
    x = np.tile(np.arange(4.0), 10)
    g = np.repeat(np.arange(10), 4)
    step = rng.normal(size=10)[g]
    cells = {
        "line": (g, x, 2 + 3 * x),
        "level": (g, x, step),
        "single rows": (np.arange(40), x, 1 + x + rng.normal(size=40)),
        "one group": (np.zeros(12), np.arange(12.0), np.arange(12.0) + rng.normal(size=12)),
        "two rows": (np.array([0, 1]), np.array([0.0, 1.0]), np.array([1.0, 3.0])),
        "one row": (np.array([0]), np.array([1.0]), np.array([1.0])),
        "flat x": (g, np.ones(40), rng.normal(size=40)),
        "usual": (g, x, step + x + rng.normal(size=40)),
    }
    pdf = pd.concat(pd.DataFrame({"cell": k, "g": a.astype(int), "x": b, "y": c}) for k, (a, b, c) in cells.items())
    df = spark.createDataFrame(pdf)
    ml = {r.cell: r for r in mixed.lmm_ml(df, ["cell"], "y", "x", "g").collect()}
    lrt = {r.cell: r for r in mixed.lmm_lrt(df, ["cell"], "y", "x", "g").collect()}
    reml = {(r.cell, r.term): r for r in mixed.lmm_reml(df, ["cell"], "y", "x", "g").collect()}
    assert set(ml) == set(lrt) == set(cells)
    for cell in ("line", "level", "two rows"):
        assert (ml[cell].deviance, ml[cell].sigma2, lrt[cell].statistic, lrt[cell].p_value) == (None,) * 4
        assert reml[cell, "slope"].std_error is None and reml[cell, "slope"].df is None and reml[cell, "slope"].p_value is None
    assert (ml["line"].slope, ml["line"].intercept) == pytest.approx((3, 2)) and reml["line", "slope"].estimate == pytest.approx(3)
    assert ml["level"].slope == pytest.approx(0, abs=1e-6)
    # One row per group: plain regression, variances unknown.
    _, b, c = cells["single rows"]
    slope, intercept = np.polyfit(b, c, 1)
    rss = ((c - intercept - slope * b) ** 2).sum()
    r = ml["single rows"]
    assert (r.slope, r.deviance) == pytest.approx((slope, 40 * (math.log(2 * math.pi * rss / 40) + 1))) and (r.ratio, r.tau2) == (None, None)
    assert reml["single rows", "slope"].std_error == pytest.approx(math.sqrt(rss / 38 / ((b - b.mean()) ** 2).sum()))
    assert reml["single rows", "slope"].df == 38 and lrt["single rows"].statistic > 0
    assert lrt["flat x"].statistic is None and ml["flat x"].slope is None and ("flat x", "slope") not in reml
    assert ml["one row"].slope is None and ml["one row"].deviance is None and reml["one row", "intercept"].estimate == 1.0
    for cell in ("one group", "usual"):
        assert all(math.isfinite(v) for v in (lrt[cell].statistic, reml[cell, "slope"].std_error, reml[cell, "slope"].p_value))


def test_degrees_of_freedom_by_differences(spark):
    """Closed derivatives against numerical ones of the dense restricted deviance."""
    g, x, y = simulated(3, 0.8, groups=25)
    out = {r.term: r for r in mixed.lmm_reml(spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y})), [], "y", "x", "g").collect()}
    design = np.column_stack([np.ones(len(y)), x - x.mean()])

    def at(r, s):
        v = s * (np.eye(len(y)) + r * (g[:, None] == g[None, :]))
        vi = np.linalg.inv(v)
        xtx = design.T @ vi @ design
        e = y - design @ np.linalg.solve(xtx, design.T @ vi @ y)
        return e @ vi @ e + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xtx)[1], np.diag(np.linalg.inv(xtx))

    grid = np.geomspace(1e-2, 10, 4000)
    r = min(grid, key=lambda t: dense_deviance(g, x, y, t, reml=True)[0])
    s = dense_deviance(g, x, y, r, reml=True)[2]
    dr, ds = 1e-3 * r, 1e-3 * s
    f = lambda a, b: at(r + a * dr, s + b * ds)[0]
    hessian = np.array([
        [(f(1, 0) - 2 * f(0, 0) + f(-1, 0)) / dr**2, (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / (4 * dr * ds)],
        [0, (f(0, 1) - 2 * f(0, 0) + f(0, -1)) / ds**2],
    ])
    hessian[1, 0] = hessian[0, 1]
    v = at(r, s)[1]
    slopes = np.stack([(at(r + dr, s)[1] - at(r - dr, s)[1]) / (2 * dr), (at(r, s + ds)[1] - at(r, s - ds)[1]) / (2 * ds)])
    for i, term in enumerate(("intercept", "slope")):
        assert out[term].df == pytest.approx(2 * v[i] ** 2 / (slopes[:, i] @ (2 * np.linalg.inv(hessian)) @ slopes[:, i]), rel=2e-2)


@pytest.mark.parametrize("low, width", [(1e6, 1.0), (0.0, 1e-13), (-5.0, 10.0)])
def test_close_values_spread_over_parts(spark, low, width):
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.lit(low) + F.col("id") * (width / 20_000)).alias("x"))
    counts = ordered.value_counts(df, ["g"], "x")
    dealt = ordered.ranged(counts, ["g"]).groupBy("part").count()
    most, cells = dealt.agg(F.max("count"), F.count("count")).first()
    assert cells >= 200 and most < 400
    wrong = ordered.running_counts(counts, ["g"]).withColumn("rank", F.round((F.col("value") - low) / (width / 20_000)))
    assert wrong.where("before <> rank").count() == 0


def test_one_far_value_leaves_the_others_spread(spark):
    x = F.when(F.col("id") == 0, F.lit(1.0005)).otherwise(F.lit(1.0) - F.col("id") * 1e-13)
    counts = ordered.value_counts(spark.range(50_000).select(F.lit("g").alias("g"), x.alias("x")), ["g"], "x")
    n = counts.count()
    assert ordered.ranged(counts, ["g"]).groupBy("part").count().agg(F.max("count")).first()[0] < n / 100
    assert ordered.running_counts(counts, ["g"]).where("value > 1.0001").first().before == 49_999
