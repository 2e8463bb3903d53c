"""SQL text for tail probabilities and mixed models, which the checking engine lacks.

Tails are integrals over smooth functions, taken by Simpson's rule.  A mixed model is fitted as the operator does it, by rounds that
narrow the variance ratio, each round one group-by over size classes.
"""

from __future__ import annotations

_PANELS = 2000


def _simpson(value: str, start: str, end: str) -> str:
    """Integral of ``value`` (of ``t``) over (start, end)."""
    weight = f"case when i in (0, {_PANELS}) then 1 when i % 2 = 1 then 4 else 2 end"
    point = f"(({start}) + (({end}) - ({start})) * i / {float(_PANELS)}::double)"
    terms = f"list_transform(range({_PANELS + 1}), lambda i: ({weight}) * {value.replace('<t>', point)})"
    return f"(list_sum({terms}) * (({end}) - ({start})) / {3.0 * _PANELS}::double)"


def normal_upper(z: str) -> str:
    """P(Z > z)."""
    density = "exp(-<t> * <t> / 2) / sqrt(2 * pi())"
    tail = _simpson(density, f"abs({z})", f"abs({z}) + 12")
    return f"(case when ({z}) >= 0 then {tail} else 1 - {tail} end)"


def f_upper(f: str, d1: str, d2: str) -> str:
    """P(F > f), as an integral over the angle whose tangent is sqrt(d1 F / d2)."""
    root = f"sqrt(({d1}) * ({f}))"
    log_beta = f"(lgamma(({d1}) / 2.0::double) + lgamma(({d2}) / 2.0::double) - lgamma((({d1}) + ({d2})) / 2.0::double))"
    value = f"2 * power(sin(<t>), ({d1}) - 1) * exp((({d2}) - 1) * ln(greatest(cos(<t>), 1e-300)) - {log_beta})"
    # With many degrees of freedom all of it lies near the start.
    end = f"case when ({d2}) < 200 then pi() / 2 else atan(({root} + 14) / sqrt({d2})) end"
    return f"least(1.0::double, {_simpson(value, f'atan({root} / sqrt({d2}))', end)})"


def t_two_sided(t: str, df: str) -> str:
    return f_upper(f"({t}) * ({t})", "1", df)


def t_upper(t: str, df: str) -> str:
    return f"(case when ({t}) >= 0 then {t_two_sided(t, df)} / 2 else 1 - {t_two_sided(t, df)} / 2 end)"


def t_quantile(z: str, df: str) -> str:
    """Quantile of t from that of the normal, by the expansion in 1 / df (many degrees of freedom)."""
    terms = [
        f"(power({z}, 3) + {z}) / 4 / ({df})",
        f"(5 * power({z}, 5) + 16 * power({z}, 3) + 3 * {z}) / 96 / power({df}, 2)",
        f"(3 * power({z}, 7) + 19 * power({z}, 5) + 17 * power({z}, 3) - 15 * {z}) / 384 / power({df}, 3)",
        f"(79 * power({z}, 9) + 776 * power({z}, 7) + 1482 * power({z}, 5) - 1920 * power({z}, 3) - 945 * {z}) / 92160 / power({df}, 4)",
    ]
    return f"({z} + {' + '.join(terms)})"


def mixed_fit(source: str, by: str, y: str, x: str, group: str, tag: str = "", slope: bool = True, reml: bool = False) -> str:
    """CTEs (after ``with``) that end in ``fit{tag}``: one row per cell with the fitted ratio and the sums and coefficients there.

    Columns: the keys, r (NULL without residual), ok, known (r can be told), ws (with slope), p, total, groups, cx, cy, a, b, d, slope, b0, rss, dev, and
    the first and second derivatives of the sums (a1 .. q1, a2 .. q2), hs, hs2.
    """
    keys = ", ".join(k.strip() for k in by.split(","))
    using = f"using ({keys})"
    p = "case when ws then 2 else 1 end"

    def at(points: str) -> str:
        """Sums, coefficients, deviance and its derivative at the ratios ``r`` of a table (keys, k, r)."""
        return f"""
            select *, freedom * (ln(2 * pi() * greatest(rss, 1e-300) / nullif(freedom, 0)) + 1) + logs {"+ ln(det)" if reml else ""} as dev,
                freedom * (q1 - 2 * (b0 * u1 + slope * v1) + b0 * b0 * a1 + 2 * b0 * slope * b1 + slope * slope * d1) / nullif(rss, 0)
                + hs {"+ case when ws then (a1 * d + a * d1 - 2 * b * b1) / det else a1 / a end" if reml else ""} as grad
            from (select *, greatest(q - b0 * u - slope * v, 0) as rss, case when ws then a * d - b * b else a end as det,
                         {f"total - {p}" if reml else "total"} as freedom, {p} as p
                  from (select *, (u - b * slope) / a as b0
                        from (select *, case when ws then (a * v - b * u) / (a * d - b * b) else 0 end as slope
                              from (select {keys}, k, r, max(total) as total, bool_and(ws) as ws, sum(m * ln(1 + r * rows_)) as logs,
                                           sum(m * rows_ / h) as hs, sum(m * rows_ * rows_ / h / h) as hs2,
                                           sum(m * rows_ / h) as a, sum(sx / h) as b, sum(sxx - r / h * x2) as d,
                                           sum(sy / h) as u, sum(sxy - r / h * xy) as v, sum(syy - r / h * y2) as q,
                                           -sum(m * rows_ * rows_ / h / h) as a1, -sum(rows_ * sx / h / h) as b1, -sum(x2 / h / h) as d1,
                                           -sum(rows_ * sy / h / h) as u1, -sum(xy / h / h) as v1, -sum(y2 / h / h) as q1,
                                           sum(2 * m * rows_ * rows_ * rows_ / h / h / h) as a2, sum(2 * rows_ * rows_ * sx / h / h / h) as b2,
                                           sum(2 * rows_ * x2 / h / h / h) as d2, sum(2 * rows_ * rows_ * sy / h / h / h) as u2,
                                           sum(2 * rows_ * xy / h / h / h) as v2, sum(2 * rows_ * y2 / h / h / h) as q2
                                    from (select *, 1 + r * rows_ as h from {points} join cls{tag} {using} join cell{tag} {using}) group by {keys}, k, r))))"""

    first = "ln(1e-8::double) + i * (ln(1e8::double) - ln(1e-8::double)) / 128"
    ctes = [
        f"""rows{tag} as (select {keys}, {group} as g, y - avg(y) over w as y, x - avg(x) over w as x, avg(x) over w as cx, avg(y) over w as cy
                from (select *, {y} as y, {x} as x from {source}) where y is not null and x is not null and {group} is not null
                window w as (partition by {keys}))""",
        f"""grp{tag} as (select {keys}, g, count(*) as rows_, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy,
                max(cx) as cx, max(cy) as cy from rows{tag} group by {keys}, g)""",
        f"""cls{tag} as materialized (select {keys}, rows_::double as rows_, count(*)::double as m, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy, sum(syy) as syy,
                sum(sx * sx) as x2, sum(sx * sy) as xy, sum(sy * sy) as y2 from grp{tag} group by {keys}, rows_)""",
        f"""cell{tag} as materialized (select *, {"txx > 1e-12 * greatest(1, total * cx * cx)" if slope else "false"} as ws
                from (select {keys}, sum(rows_)::double as total, count(*) as groups, max(rows_) > 1 as identified, max(cx) as cx, max(cy) as cy, sum(sxx) as txx
                      from grp{tag} group by {keys}))""",
        f"grid{tag} as (select {keys}, i as k, exp({first}) as r from cell{tag} cross join (select unnest(range(129)) as i))",
        f"""pick{tag}0 as materialized (select {keys}, max(dev) - min(dev) <= 1e-9 as flat,
                    max(dev) filter (k = 128) <= min(dev) + 1e-9 as top, arg_min(k, (dev, k)) as k0 from ({at(f"grid{tag}")}) group by {keys})""",
        f"""round{tag}0 as materialized (select {keys}, flat, top, {first.replace("i *", "greatest(k0 - 1, 0) *")} as lo,
                {first.replace("i *", "least(k0 + 1, 128) *")} as hi from pick{tag}0)""",
    ]
    for number in range(1, 13):
        before = f"round{tag}{number - 1}"
        ctes.append(f"""cut{tag}{number} as (select {keys}, i as k, exp(lo + (hi - lo) * i / 16.0::double) as r from {before} cross join (select unnest(range(1, 16)) as i))""")
        ctes.append(f"""round{tag}{number} as materialized (select {keys}, flat, top, lo + (hi - lo) * (up - 1) / 16.0::double as lo, lo + (hi - lo) * up / 16.0::double as hi
            from {before} join (select {keys}, coalesce(min(k) filter (grad >= 0), 16) as up from ({at(f"cut{tag}{number}")}) group by {keys}) {using})""")
    ctes += [
        f"""last{tag} as (select {keys}, 0 as k, 0.0::double as r from cell{tag} union all select {keys}, 1, exp((lo + hi) / 2) from round{tag}12
                union all select {keys}, 2, 1e8::double from cell{tag})""",
        f"ends{tag} as materialized ({at(f'last{tag}')})",
        f"""best{tag} as (select {keys}, case when not identified or flat then 0 when top then 2 when dev0 <= dev1 then 0 else 1 end as k,
                    not identified or flat or not top as inside, identified and not flat as known
                from cell{tag} join round{tag}12 {using}
                join (select {keys}, max(dev) filter (k = 0) as dev0, max(dev) filter (k = 1) as dev1 from ends{tag} group by {keys}) {using})""",
        # A perfect fit has no likelihood; its coefficients are those of the largest ratio.
        f"""state{tag} as (select {keys}, known, case when inside and rss > 1e-10 * q and freedom > 0 then k else 2 end as k,
                    inside and rss > 1e-10 * q and freedom > 0 as ok from best{tag} join ends{tag} using ({keys}, k))""",
        f"""fit{tag} as materialized (select e.* exclude (k, r, total, ws), c.*, case when ok then r end as r, ok, known
                from state{tag} s join ends{tag} e using ({keys}, k) join cell{tag} c {using})""",
    ]
    return ",\n".join(ctes)
