"""Published tables rebuilt from their inputs."""

import re

import pytest

from clozeframe.functions import tails
from clozeframe.plans.reports import lrt_report, neutral_report
from golden import LRT_RELATIONS, LRT_RELATIONS_WIDE, NEUTRAL_RELATION, rows


def test_lrt_report(spark):
    data = [
        (m, d, f"{r.lower()} ({n})", int(n), float(s), float(e)) for m, d, r, n, s, _, _, e in rows(LRT_RELATIONS)
    ]
    lrt = spark.createDataFrame(
        data, "model string, dataset string, relation string, n int, statistic double, fixed_effect double"
    )
    got = [tuple(r) for r in lrt_report(lrt.repartition(4), ["sentence", "word"]).collect()]
    assert got == [(m, r, int(n), *map(float, rest)) for m, r, n, *rest in rows(LRT_RELATIONS_WIDE)]


def test_chi_square_tail(spark):
    data = [(float(r[4]), float(r[6])) for r in rows(LRT_RELATIONS)]
    df = spark.createDataFrame(data, "x double, p double")
    for x, p, got in df.withColumn("got", tails.chi2_p_value("x")).collect():
        # The published statistic has two decimals.
        assert got == pytest.approx(p, rel=3e-3)


def test_neutral_report(spark):
    data = []
    for relation, n, *cells in rows(NEUTRAL_RELATION):
        for i, context in enumerate(("sentence", "word")):
            f, se = map(float, re.split(r"\$\\pm\$", cells[i]))
            data.append((0, context, f"{relation.lower()} ({n})", int(n), f, se, float(cells[2 + i][:-1]) / 100))
    summary = spark.createDataFrame(
        data, "bucket int, context_type string, relation string, n int, f double, se double, facilitated double"
    )
    got = [list(map(str, r)) for r in neutral_report(summary, ["sentence", "word"]).collect()]
    assert got == rows(NEUTRAL_RELATION)
