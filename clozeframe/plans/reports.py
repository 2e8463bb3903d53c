"""Published tables built from summaries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.functions import labels
from clozeframe.operators.reshape import order_by, to_wide_multi


def lrt_report(lrt: DataFrame, datasets: list[str]) -> DataFrame:
    """Rounded likelihood-ratio tests, data sets side by side, ordered by model and relation count."""
    rounded = lrt.select(
        "model",
        "dataset",
        labels.fmt_title(labels.fmt_strip_count("relation")).alias("relation"),
        "n",
        F.bround("statistic", 2).alias("statistic"),
        F.bround("fixed_effect", 2).alias("fixed_effect"),
    )
    wide = to_wide_multi(rounded, ["model", "relation", "n"], "dataset", ["statistic", "fixed_effect"], datasets)
    return order_by(wide, "model", "-n")


def neutral_report(summary: DataFrame, context_types: list[str]) -> DataFrame:
    """Neutral-context facilitation and share per relation as text, context types side by side."""
    shown = summary.where(F.col("bucket") == 0).select(
        labels.fmt_title(labels.fmt_strip_count("relation")).alias("relation"),
        "n",
        "context_type",
        labels.fmt_mean_error("f", "se").alias("f"),
        labels.fmt_percent("facilitated").alias("facilitated"),
    )
    wide = to_wide_multi(shown, ["relation", "n"], "context_type", ["f", "facilitated"], context_types)
    return order_by(wide, "-n")
