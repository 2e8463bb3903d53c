"""Queries on regressions, tests and mixed models.

The ``*_p`` queries add tail probabilities and confidence bounds, which SQL gets by quadrature (``statistics_sql``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clozeframe.functions import measures
from clozeframe.operators import joins, lexicon, mixed, reshape, stats
from clozeframe.plans import statistics_sql as tail
from clozeframe.plans.catalog_results import _TITLE
from clozeframe.plans.registry import query
from clozeframe.plans.reports import lrt_report
from clozeframe.plans.views import NORMS

CELL = ["model", "context_type"]


def _bits():
    return measures.facilitation()


def _glance_sql(source: str, by: str, y: str, x: str, scaled: bool = False) -> str:
    slope = f"regr_slope({y}, {x})" + (f" * stddev_samp({x})" if scaled else "")
    intercept = f"avg({y})" if scaled else f"regr_intercept({y}, {x})"
    return f"""
        select {by}, slope, intercept, r2 as r_squared, 1 - (1 - r2) * (n - 1) / (n - 2) as adj_r_squared,
               sqrt(rss / (n - 2)) as sigma, r2 / (1 - r2) * (n - 2) as statistic, 1 as df,
               -0.5::double * n * (ln(2 * pi() * rss / n) + 1) as "logLik",
               n * (ln(2 * pi() * rss / n) + 1) + 6 as "AIC",
               n * (ln(2 * pi() * rss / n) + 1) + 3 * ln(n) as "BIC", rss as deviance, n - 2 as df_residual, n as nobs
        from (select *, syy * (1 - r2) as rss
              from (select {by}, {slope} as slope, {intercept} as intercept, regr_r2({y}, {x}) as r2,
                           regr_syy({y}, {x}) as syy, cast(regr_count({y}, {x}) as bigint) as n
                    from {source} group by {by}))"""


_GLANCE_DOUBLES = "slope intercept r_squared adj_r_squared sigma statistic logLik AIC BIC deviance"


def _binned(v):
    return v.kept.where(F.col("bucket") != 0)


_ON_CONSTRAINT = _glance_sql("(select * from kept where bucket <> 0)", "model, context_type", "f", '"constraint"')


@query(_ON_CONSTRAINT, _GLANCE_DOUBLES)
def regression_on_constraint(v):
    return stats.lm_glance(_binned(v), CELL, _bits(), "constraint", p_values=False)


@query(f"""select *, {tail.f_upper("statistic", "df", "df_residual")} as p_value from ({_ON_CONSTRAINT})""", f"{_GLANCE_DOUBLES} p_value")
def regression_on_constraint_p(v):
    return stats.lm_glance(_binned(v), CELL, _bits(), "constraint")


@query(
    _glance_sql("(select * from kept join context_entropy using (isolated_context))", "model, context_type", "f", "entropy"),
    _GLANCE_DOUBLES,
)
def regression_on_entropy(v):
    rows = joins.join_entropy(v.kept, v.context_entropy, constraint=None)
    return stats.lm_glance(rows, CELL, _bits(), "entropy", p_values=False)


_NORM_ROWS = """(select kept.*, task, delta
    from kept join (select target, related, unrelated, 'delta_200ms' as task, delta_200ms as delta from lex
                    union all select target, related, unrelated, 'delta_1200ms', delta_1200ms from lex) n
      using (target, related, unrelated)
    where target not in (select target from lex where delta_200ms is null or delta_1200ms is null))"""


def _norm_rows(v):
    lex = lexicon.exclude_targets(v.lex, v.lex, NORMS, [])
    columns = ["model", "dataset", "bucket", "target", "related", "unrelated"]
    rows = v.kept.select(*columns, _bits().alias("f"), measures.facilitation(kind="difference").alias("diff"))
    return joins.join_norms(rows, lex, NORMS)


@query(_glance_sql(_NORM_ROWS, "model, dataset, task", "delta", "diff", scaled=True), _GLANCE_DOUBLES)
def norms_on_scaled_facilitation(v):
    return stats.lm_glance(
        _norm_rows(v), ["model", "dataset", "task"], "delta", "diff", scale_x=True, p_values=False
    )


@query(
    f"select model, bucket, task, corr(f, delta) as correlation from {_NORM_ROWS} where dataset = 'word' group by model, bucket, task",
    "correlation",
)
def norm_correlations(v):
    rows = _norm_rows(v).where(F.col("dataset") == "word")
    return stats.corr_by(rows, ["model", "bucket", "task"], "f", "delta")


_COR_SQL = """
    select model, r as estimate, r * sqrt((n - 2) / (1 - r * r)) as statistic, n - 2 as parameter,
           tanh(atanh(r) - 1.959963984540054::double / sqrt(n - 3)) as conf_low,
           tanh(atanh(r) + 1.959963984540054::double / sqrt(n - 3)) as conf_high
    from (select model, corr("constraint", isolated_probability) as r, count(*) as n from kept group by model)"""


@query(_COR_SQL, "estimate statistic conf_low conf_high")
def constraint_correlation_test(v):
    return stats.cor_test(v.kept, ["model"], "constraint", "isolated_probability", p_values=False)


@query(f"""select *, {tail.t_two_sided("statistic", "parameter")} as p_value from ({_COR_SQL})""", "estimate statistic conf_low conf_high p_value")
def constraint_correlation_test_p(v):
    return stats.cor_test(v.kept, ["model"], "constraint", "isolated_probability")


@query(
    """select model, bucket, context_type, avg(f) as estimate, avg(f) / (stddev_samp(f) / sqrt(count(f))) as statistic,
              count(f) - 1 as parameter from kept group by model, bucket, context_type""",
    "estimate statistic",
)
def facilitation_t_test(v):
    return stats.t_test_1(v.kept, ["model", "bucket", "context_type"], _bits(), p_values=False)


_Z_95, _Z_975 = "1.6448536269514722::double", "1.959963984540054::double"


@query(
    f"""select * exclude (se), {tail.t_upper("statistic", "parameter")} as p_value,
               estimate - {tail.t_quantile(_Z_95, "parameter")} * se as conf_low, 'inf'::double as conf_high
        from (select model, bucket, context_type, avg(f) as estimate, avg(f) / (stddev_samp(f) / sqrt(count(f))) as statistic,
                     count(f) - 1 as parameter, stddev_samp(f) / sqrt(count(f)) as se from kept group by model, bucket, context_type)""",
    "estimate statistic p_value conf_low",
)
def facilitation_t_test_p(v):
    return stats.t_test_1(v.kept, ["model", "bucket", "context_type"], _bits())


_WELCH = """
    select {by}, ma - mb as estimate, ma as estimate1, mb as estimate2, (ma - mb) / sqrt(qa + qb) as statistic,
           (qa + qb) * (qa + qb) / (qa * qa / (na - 1) + qb * qb / (nb - 1)) as parameter
    from (select {by}, avg(a) as ma, avg(b) as mb, count(a) as na, count(b) as nb,
                 var_samp(a) / count(a) as qa, var_samp(b) / count(b) as qb from ({wide}) group by {by})"""
_ITEM_F = "log2(related_probability) - log2(unrelated_probability)"
_BY_CONTEXT = _WELCH.format(
    by="model, bucket",
    wide=f"""select model, bucket, target, max({_ITEM_F}) filter (where context_type = 'sentence') as a,
                    max({_ITEM_F}) filter (where context_type = 'word') as b from items group by model, bucket, target""",
)
_BY_MODEL = _WELCH.format(
    by="context_type, bucket",
    wide=f"""select context_type, bucket, target, max({_ITEM_F}) filter (where model = 'A') as a,
                    max({_ITEM_F}) filter (where model = 'R') as b from items group by context_type, bucket, target""",
)
_WELCH_DOUBLES = "estimate estimate1 estimate2 statistic parameter"


def _context_pairs(v):
    rows = v.items.withColumn("f", _bits())
    return reshape.to_wide(rows, ["model", "bucket", "target"], "context_type", "f", ["sentence", "word"])


def _model_pairs(v):
    rows = v.items.withColumn("f", _bits())
    return reshape.to_wide(rows, ["context_type", "bucket", "target"], "model", "f", ["A", "R"])


@query(_BY_CONTEXT, _WELCH_DOUBLES)
def context_welch_test(v):
    return stats.t_test_2(_context_pairs(v), ["model", "bucket"], "sentence", "word", "greater", p_values=False)


@query(
    f"""select *, {tail.t_upper("statistic", "parameter")} as p_value,
               estimate - {tail.t_quantile(_Z_95, "parameter")} * (estimate / statistic) as conf_low, 'inf'::double as conf_high
        from ({_BY_CONTEXT})""",
    f"{_WELCH_DOUBLES} p_value conf_low",
)
def context_welch_test_p(v):
    return stats.t_test_2(_context_pairs(v), ["model", "bucket"], "sentence", "word", "greater")


@query(_BY_MODEL, _WELCH_DOUBLES)
def model_welch_test(v):
    return stats.t_test_2(_model_pairs(v), ["context_type", "bucket"], "A", "R", "less", p_values=False)


_RANK_SUM = """
    select model, bucket, n_x, n_y, statistic,
           sqrt(n_x * n_y / 12.0::double * (n_x + n_y + 1 - ties / ((n_x + n_y) * (n_x + n_y - 1.0::double)))) as sigma, within
    from (select model, bucket, count(*) filter (where side = 'a') as n_x, count(*) filter (where side = 'b') as n_y,
                 sum(mid) filter (where side = 'a') - n_x * (n_x + 1.0::double) / 2.0::double as statistic,
                 sum(t * t - 1.0::double) as ties, sum(own * own - 1.0::double) as within
          from (select model, bucket, side, count(*) over (partition by model, bucket, x) as t,
                       count(*) over (partition by model, bucket, side, x) as own,
                       rank() over (partition by model, bucket order by x) + (t - 1) / 2.0::double as mid
                from (select model, bucket, 'a' as side, related_probability as x from kept
                      union all select model, bucket, 'b', unrelated_probability from kept))
          group by model, bucket)"""
_RANK_Z = "(statistic - n_x * n_y / 2.0::double - {0}) / sigma"


@query(f"select model, bucket, n_x, n_y, statistic from ({_RANK_SUM})", "statistic")
def probability_rank_sum(v):
    return stats.rank_sum(
        v.kept, ["model", "bucket"], "related_probability", "unrelated_probability", p_values=False
    )


@query(
    f"""select model, bucket, n_x, n_y, statistic, least(1.0::double, 2 * {tail.normal_upper("abs(z)")}) as p_value
        from (select *, {_RANK_Z.format("sign(statistic - n_x * n_y / 2.0::double) * 0.5::double")} as z from ({_RANK_SUM}))""",
    "statistic p_value",
)
def probability_rank_sum_p(v):
    return stats.rank_sum(v.kept, ["model", "bucket"], "related_probability", "unrelated_probability")


# All differences of distinct values, largest first, with how many lie above or at each.
@query(
    f"""with tested as (
            select *, floor(n_x * n_y / 2.0::double) + 1 as half,
                   floor(n_x * n_y / 2.0::double + 0.5::double + {_Z_95}
                         * sqrt(n_x * n_y / 12.0::double * (n_x + n_y + 1 - within / ((n_x + n_y) * (n_x + n_y - 1.0::double))))) + 1 as low
            from ({_RANK_SUM})),
        a as (select model, bucket, related_probability as x, count(*) as n from kept where related_probability is not null group by all),
        b as (select model, bucket, unrelated_probability as y, count(*) as n from kept where unrelated_probability is not null group by all),
        d as (select model, bucket, x - y as d, sum(a.n * b.n) as w from a join b using (model, bucket) group by all),
        u as (select *, sum(w) over (partition by model, bucket order by d desc) as up_to from d)
        select model, bucket, n_x, n_y, statistic, {tail.normal_upper("z")} as p_value, estimate, conf_low, 'inf'::double as conf_high
        from (select model, bucket, any_value(n_x) as n_x, any_value(n_y) as n_y, any_value(statistic) as statistic,
                     any_value({_RANK_Z.format("0.5::double")}) as z, max(d) filter (up_to >= half) as estimate, max(d) filter (up_to >= low) as conf_low
              from tested join u using (model, bucket) group by model, bucket)""",
    "statistic p_value estimate conf_low",
)
def probability_rank_sum_interval(v):
    return stats.rank_sum(v.kept, ["model", "bucket"], "related_probability", "unrelated_probability", "greater", ci=True)


_ANOVA = """select model, context_type, k - 1 as df, cast(n - k as bigint) as df_residual, ssb as sumsq, ssw as sumsq_residual,
              ssb / (k - 1) as meansq, ssw / (n - k) as meansq_residual, (ssb / (k - 1)) / (ssw / (n - k)) as statistic
       from (select model, context_type, count(*) as k, sum(n) as n, sum(n * power(m - grand, 2)) as ssb, sum(v * n) as ssw
             from (select model, context_type, bucket, count(*) as n, avg(diff) as m, var_pop(diff) as v from kept group by all)
             join (select model, context_type, avg(diff) as grand from kept group by all) using (model, context_type)
             group by model, context_type)"""
_ANOVA_DOUBLES = "sumsq sumsq_residual meansq meansq_residual statistic"


@query(_ANOVA, _ANOVA_DOUBLES)
def bucket_anova(v):
    return stats.anova_1(v.kept, CELL, measures.facilitation(kind="difference"), "bucket", p_values=False)


@query(f"""select *, {tail.f_upper("statistic", "df", "df_residual")} as p_value from ({_ANOVA})""", f"{_ANOVA_DOUBLES} p_value")
def bucket_anova_p(v):
    return stats.anova_1(v.kept, CELL, measures.facilitation(kind="difference"), "bucket")


_POINTS = 20


_FIT_LINE = f"""select model, cast(i as integer) as point, lo + i * (hi - lo) / {_POINTS - 1} as x,
               intercept + slope * (lo + i * (hi - lo) / {_POINTS - 1}) as fit,
               sqrt(syy * (1 - r2) / (n - 2)) * sqrt(1.0::double / n + power(lo + i * (hi - lo) / {_POINTS - 1} - mx, 2) / sxx) as se
        from (select model, regr_slope(f, "constraint") as slope, regr_intercept(f, "constraint") as intercept,
                     regr_r2(f, "constraint") as r2, regr_syy(f, "constraint") as syy, regr_sxx(f, "constraint") as sxx,
                     avg("constraint") as mx, count(*) as n, min("constraint") as lo, max("constraint") as hi
              from kept group by model) cross join (select unnest(range({_POINTS})) as i)"""


@query(_FIT_LINE, "x fit se")
def constraint_fit_line(v):
    return stats.fit_band(v.kept, ["model"], _bits(), "constraint", grid=_POINTS, band=False)


@query(
    f"""select * exclude (df), fit - {tail.t_quantile(_Z_975, "df")} * se as lower, fit + {tail.t_quantile(_Z_975, "df")} * se as upper
        from ({_FIT_LINE}) join (select model, count(*) - 2 as df from kept where f is not null and "constraint" is not null group by model) using (model)""",
    "x fit se lower upper",
)
def constraint_fit_band(v):
    return stats.fit_band(v.kept, ["model"], _bits(), "constraint", grid=_POINTS)


# --- mixed models ---------------------------------------------------------------------------------

_RATIOS = [0.0, 0.05, 1.0, 20.0]


@query(
    f"""with r as (select model, context_type, target, f, "constraint" - avg("constraint") over w as x, f - avg(f) over w as y,
                          avg("constraint") over w as cx, avg(f) over w as cy
                   from kept window w as (partition by model, context_type)),
            t as (select model, context_type, target, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx,
                         sum(x * y) as sxy, sum(y * y) as syy, max(cx) as cx, max(cy) as cy from r group by all),
            s as (select model, context_type, ratio, sum(n) as total, sum(ln(1 + ratio * n)) as logs,
                         sum(n - w * n * n) as a, sum(sx - w * n * sx) as b, sum(sxx - w * sx * sx) as d,
                         sum(sy - w * n * sy) as u, sum(sxy - w * sx * sy) as v, sum(syy - w * sy * sy) as q,
                         max(cx) as cx, max(cy) as cy
                  from (select t.*, ratio, ratio / (1 + ratio * n) as w
                        from t cross join (select unnest([{", ".join(f"{r}::double" for r in _RATIOS)}]) as ratio))
                  group by all)
       select model, context_type, ratio, slope, b0 + cy - slope * cx as intercept,
              total * (ln(2 * pi() * (q - b0 * u - slope * v) / total) + 1) + logs as deviance
       from (select *, (u - b * slope) / a as b0 from (select *, (a * v - b * u) / (a * d - b * b) as slope from s))""",
    "slope intercept deviance",
)
def mixed_model_deviance(v):
    classes = mixed.size_classes(v.kept, CELL, _bits(), "constraint", "target")
    return mixed.deviance_at(classes, CELL, _RATIOS)


_ML_FIT = tail.mixed_fit("kept", "model, context_type", "f", '"constraint"', "target")


@query(
    f"""with {_ML_FIT}
        select model, context_type, case when ws then slope end as slope, b0 + cy - slope * cx as intercept, case when known then r end as ratio,
               case when ok and known then rss / total end as sigma2, case when known then r * rss / total end as tau2,
               case when ok then -dev / 2 end as "logLik", case when ok then dev end as deviance, cast(total as bigint) as nobs, groups
        from fit""",
    "slope intercept ratio sigma2 tau2 logLik deviance",
)
def mixed_model_ml(v):
    return mixed.lmm_ml(v.kept, CELL, _bits(), "constraint", "target")


def _lrt_sql(source: str, by: str) -> str:
    """CTEs and a statement for the likelihood-ratio test of the slope."""
    full = tail.mixed_fit(source, by, "f", '"constraint"', "target", "_full")
    null = tail.mixed_fit(source, by, "f", '"constraint"', "target", "_null", slope=False)
    return f"""with {full},
        {null},
        lrt as materialized (
            select {by}, case when a.ws and a.ok and b.ok then greatest(b.dev - a.dev, 0) end as statistic, 1 as df,
                   case when a.ws then a.slope end as fixed_effect
            from fit_full a join fit_null b using ({by}))"""


_LRT = f"""statistic, df, 2 * {tail.normal_upper("sqrt(statistic)")} as p_value, fixed_effect from lrt"""
_LRT_DOUBLES = "statistic p_value fixed_effect"
_RELATION_LRT = _lrt_sql("related_results join top using (relation)", "model, dataset, relation, n")


@query(f"""{_lrt_sql("kept", "model, dataset")} select model, dataset, {_LRT}""", _LRT_DOUBLES)
def mixed_model_lrt(v):
    return mixed.lmm_lrt(v.kept, ["model", "dataset"], _bits(), "constraint", "target")


def _relation_lrt(v):
    columns = ["model", "dataset", "constraint", "target"]
    rows = reshape.instance_table(v.kept, v.lex, v.top, columns)
    return mixed.lmm_lrt(rows, ["model", "dataset", "relation", "n"], "facilitation", "constraint", "target")


@query(f"{_RELATION_LRT} select model, dataset, relation, n, {_LRT}", _LRT_DOUBLES)
def mixed_model_lrt_by_relation(v):
    return _relation_lrt(v)


def _side(value: str) -> str:
    return ", ".join(f"max(round_even({value}, 2)) filter (where dataset = '{d}') as {value}_{d}" for d in ("sentence", "word"))


@query(
    f"""{_RELATION_LRT} select model, {_TITLE.format("relation")} as relation, n, {_side("statistic")}, {_side("fixed_effect")}
        from lrt group by 1, 2, 3""",
    "statistic_sentence statistic_word fixed_effect_sentence fixed_effect_word",
)
def mixed_model_lrt_report(v):
    return lrt_report(_relation_lrt(v), ["sentence", "word"])


_BINNED_FIT = tail.mixed_fit("(select * from kept where bucket <> 0)", "model, context_type", "f", '"constraint"', "target", reml=True)
# The curvature of the restricted deviance in the ratio and the residual variance, and the derivatives of the coefficients' variances.
_REML_TABLE = f"""
    select model, context_type, term, estimate, std_error, freedom as df, statistic,
           case when freedom is not null then {tail.t_two_sided("statistic", "freedom")} end as p_value
    from (select *, estimate / std_error as statistic,
                 case when r = 0 then free when rr > 0 and rr * ss - rs * rs > 1e-12 * rr * ss
                      then 2 * v * v * (rr * ss - rs * rs) / (2 * (ss * by_r * by_r - 2 * rs * by_r * i + rr * i * i)) end as freedom
          from (select model, context_type, term, estimate, r, free, i, rr, rs, ss, -spread * s as by_r, i * s as v, sqrt(i * s) as std_error
                from (select *, -hs2 + rss2 / s + turn as rr, -rss1 / (s * s) as rs, -free / (s * s) + 2 * rss / (s * s * s) as ss,
                             unnest(case when ws then ['intercept', 'slope'] else ['intercept'] end) as term,
                             unnest([b0 + cy, slope]) as estimate, unnest([i11, i22]) as i, unnest([s11, s22]) as spread
                      from (select *, q2 - 2 * (b0 * u2 + slope * v2) + b0 * b0 * a2 + 2 * b0 * slope * b2 + slope * slope * d2
                                   - 2 * (p1 * p1 * i11 + 2 * p1 * p2 * i12 + p2 * p2 * i22) as rss2,
                                   i11 * a2 + 2 * i12 * b2 + i22 * d2 - (s11 * a1 + 2 * s12 * b1 + s22 * d1) as turn
                            from (select *, i11 * i11 * a1 + 2 * i11 * i12 * b1 + i12 * i12 * d1 as s11,
                                         i12 * i12 * a1 + 2 * i12 * i22 * b1 + i22 * i22 * d1 as s22,
                                         i11 * i12 * a1 + (i11 * i22 + i12 * i12) * b1 + i12 * i22 * d1 as s12,
                                         u1 - (a1 * b0 + b1 * slope) as p1, v1 - (b1 * b0 + d1 * slope) as p2,
                                         q1 - 2 * (b0 * u1 + slope * v1) + b0 * b0 * a1 + 2 * b0 * slope * b1 + slope * slope * d1 as rss1
                                  from (select *, case when ok then rss / freedom end as s, freedom as free,
                                               case when ws then d / det else 1 / a end as i11, case when ws then -b / det else 0 end as i12,
                                               case when ws then a / det else 0 end as i22 from fit)))))
          where term is not null)"""


@query(f"with {_BINNED_FIT} {_REML_TABLE}", "estimate std_error df statistic p_value")
def mixed_model_reml(v):
    return mixed.lmm_reml(_binned(v), CELL, _bits(), "constraint", "target")


@query(
    f"""with {tail.mixed_fit("(select * from related_results join top using (relation) where bucket <> 0)", "model, context_type, relation", "f", '"constraint"', "target", reml=True)}
        select model, context_type, relation, slope from fit where ws""",
    "slope",
)
def mixed_model_reml_slopes_by_relation(v):
    rows = reshape.instance_table(_binned(v), v.lex, v.top, ["model", "context_type", "constraint", "target"])
    out = mixed.lmm_reml(rows, [*CELL, "relation"], "facilitation", "constraint", "target")
    return out.where(F.col("term") == "slope").select(*CELL, "relation", F.col("estimate").alias("slope"))
