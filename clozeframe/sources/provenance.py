"""Experiment fields held in result-file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.functions.labels import FIX_ORDER, fix_label, level_ordinal
from clozeframe.functions.text import extract


def parse_provenance(df: DataFrame, variant: str = "bucket", file: str = "file") -> DataFrame:
    """Columns from the file name.

    ``bucket``:  ``results/{model}_{word|sentence}_10.csv`` to model, context_type, dataset.
    ``fix``:     ``results/{model}_{dataset}.csv`` to model (up to the last ``_p``), dataset label and order.
    ``priming``: ``results/priming_{model}_{scenario}.csv`` to model, scenario.
    ``constraint``: ``constraints_{model}.csv`` to model.
    A field that does not match is NULL.
    """
    if variant == "bucket":
        stem = extract(file, r"results/(.*)\.csv")
        return df.withColumns(
            {
                "model": F.regexp_replace(stem, r"^(.*?)_(?:sentence|word)_10", "$1"),
                "context_type": F.when(F.contains(stem, F.lit("sentence")), F.lit("sentence")).otherwise(
                    F.lit("word")
                ),
                "dataset": extract(file, r"uncased_(.*)_10"),
            }
        )
    if variant == "fix":
        label = fix_label(extract(file, r"uncased_(.*)\.csv"))
        return df.withColumns(
            {
                "model": extract(file, r"results/(.*)_p"),
                "dataset": label,
                "dataset_ord": level_ordinal(label, FIX_ORDER),
            }
        )
    if variant == "priming":
        parts = F.split(extract(file, r"results/priming_(.*)\.csv"), "_")
        return df.withColumns({"model": F.get(parts, F.lit(0)), "scenario": F.get(parts, F.lit(1))})
    if variant == "constraint":
        return df.withColumn("model", extract(file, r"constraints_(.*)\.csv"))
    raise ValueError(f"unknown provenance variant: {variant!r}")
