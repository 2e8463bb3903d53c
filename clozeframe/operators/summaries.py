"""Grouped summaries.  Every aggregate here combines on the map side; no summary moves raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozeframe.functions import labels
from clozeframe.functions.measures import (
    Z95,
    distraction,
    facilitation,
    finite,
    mean,
    rel_facilitation,
    share,
    std_error,
)
from clozeframe.operators.joins import PAIR_KEYS, counted_relations, natural_join

BUCKET_KEYS = ("model", "bucket", "context_type", "dataset")


def facilitation_summary(df: DataFrame, by: tuple[str, ...] = BUCKET_KEYS, strict: bool = False) -> DataFrame:
    """Mean facilitation, 95 % half-width and bounds, share of facilitated rows."""
    f = facilitation()
    out = df.withColumn("_f", f).groupBy(*by).agg(
        mean("_f", strict).alias("facilitation"),
        (F.lit(Z95) * std_error("_f")).alias("se_f"),
        share(F.col("_f") > 0, strict).alias("facilitated"),
    )
    return out.withColumns(
        {
            "high_f": F.col("facilitation") + F.col("se_f"),
            "low_f": F.col("facilitation") - F.col("se_f"),
        }
    )


def relation_summary(
    df: DataFrame, lex: DataFrame, counts: DataFrame, by: tuple[str, ...] = ("bucket", "context_type")
) -> DataFrame:
    """Facilitation by relation, for the counted relations, with a ``relation (n)`` label.

    The lexicon is cut to the counted relations before it meets the results; missing keys match missing ones.  Add ``model``
    to ``by`` for one summary per model.
    """
    relations = counted_relations(lex, counts)
    f = facilitation()
    out = (
        natural_join(df, relations, PAIR_KEYS)
        .withColumn("_f", f)
        .groupBy(*by, "relation", "n")
        .agg(
            F.avg("_f").alias("f"),
            (F.lit(Z95) * std_error("_f")).alias("se"),
            share(F.col("_f") > 0).alias("facilitated"),
        )
    )
    return out.withColumns(
        {
            "high": F.col("f") + F.col("se"),
            "low": F.col("f") - F.col("se"),
            "label": labels.fmt_count("relation", "n"),
        }
    )


def split_neutral(df: DataFrame, bucket: str = "bucket") -> tuple[DataFrame, DataFrame]:
    """(neutral rows, rows with a constraint bin)."""
    return df.where(F.col(bucket) == 0), df.where(F.col(bucket) != 0)


def _shares_long(df: DataFrame, by: tuple[str, ...], shares: dict[str, Column], names: dict[str, str]) -> DataFrame:
    wide = df.groupBy(*by).agg(*[share(c).alias(k) for k, c in shares.items()])
    long = wide.unpivot(list(by), list(shares), "metric", "proportion")
    return long.withColumn("label", labels.recode("metric", names))


def distraction_shares(df: DataFrame, by: tuple[str, ...] = ("bucket", "model", "dataset")) -> DataFrame:
    """Share of facilitated rows, and of rows where the related prime lowered the target."""
    shares = {"facilitated": facilitation() > 0, "worse": distraction() < 0}
    return _shares_long(df, by, shares, labels.DISTRACTION_LABELS)


def criterion_shares(
    df: DataFrame, by: tuple[str, ...] = ("bucket", "model", "dataset"), with_rf: bool = False
) -> DataFrame:
    """Share of rows primed by the plain criterion, and by the one that rules out distraction."""
    primed = facilitation() > 0
    shares = {"pre": primed, "post": primed & (distraction() > 0)}
    if with_rf:
        shares["post2"] = primed & (rel_facilitation() > 0)
    return _shares_long(df, by, shares, labels.CRITERION_LABELS)


def argmax_shares(df: DataFrame, by: tuple[str, ...] = ("model", "scenario", "bucket")) -> DataFrame:
    """How often the top word stays, or equals the prime or the target, under each context."""
    col = F.col
    return df.groupBy(*by).agg(
        share(
            (col("isolated_argmax") == col("related_argmax")) & (col("related_argmax") == col("unrelated_argmax"))
        ).alias("prediction_unchanged"),
        share(col("related") == col("related_argmax")).alias("prime_predicted"),
        share((col("related") == col("related_argmax")) & (facilitation() < 0)).alias("related_target_demotion"),
        share((col("target") == col("isolated_argmax")) & (distraction() < 0)).alias("target_predicted"),
        share(
            (col("target") == col("unrelated_argmax"))
            & (facilitation(kind="difference") < 0)
        ).alias("target_unrelated"),
    )


STIMULUS_KEYS = ("target", "related", "unrelated", "relation", "context")


def mean_scores(df: DataFrame, keys: tuple[str, ...] = STIMULUS_KEYS) -> DataFrame:
    """Constraint and entropy averaged over models."""
    return df.groupBy(*keys).agg(
        F.avg(finite("constraint")).alias("constraint"), F.avg(finite("entropy")).alias("entropy")
    )


def mean_constraint_by_bin(df: DataFrame, bucket: str = "category") -> DataFrame:
    """Mean constraint per bin, each item counted once over all models."""
    items = df.select(bucket, "constraint", *PAIR_KEYS).distinct()
    return items.groupBy(bucket).agg(F.avg(finite("constraint")).alias("constraint"))


def mean_entropy_by_bin(df: DataFrame, by: tuple[str, ...] = ("model", "category")) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(finite("entropy")).alias("entropy"))


FIX_KEYS = ("model", "dataset", "constraint")


def fix_summary(df: DataFrame, by: tuple[str, ...] = FIX_KEYS) -> DataFrame:
    """Row count, mean probability difference, mean log ratio, share above and at-or-above."""
    d = facilitation(kind="difference")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("facilitation"),
        F.avg(facilitation(kind="nats")).alias("facilitation_surprisal"),
        share(d > 0).alias("primed"),
        share(d >= 0).alias("primed_or_equal"),
    )


def fix_summary_by_relation(
    df: DataFrame, lex: DataFrame, counts: DataFrame, by: tuple[str, ...] = FIX_KEYS
) -> DataFrame:
    """Share of primed rows and mean probability difference per relation; missing keys match missing ones."""
    relations = counted_relations(lex, counts)
    d = facilitation(kind="difference")
    out = natural_join(df, relations, PAIR_KEYS).groupBy(*by, "relation", "n").agg(
        share(d > 0).alias("primed"), F.avg(d).alias("facilitation")
    )
    return out.withColumn("label", labels.fmt_count("relation", "n", space=False))


def mean_sd_share(df: DataFrame, by: tuple[str, ...] = ("model", "constraint")) -> DataFrame:
    """Mean and deviation of facilitation in bits, share of facilitated rows."""
    f = facilitation()
    return df.groupBy(*by).agg(
        F.avg(f).alias("facilitation"), F.stddev_samp(f).alias("sd"), share(f > 0).alias("primed")
    )


def mean_bounds(df: DataFrame, by: tuple[str, ...] = ("model", "constraint"), kind: str = "sd") -> DataFrame:
    """Mean facilitation with bounds of one deviation (``sd``) or 1.96 standard errors (``se``)."""
    f = facilitation()
    width = {"sd": F.stddev_samp(f), "se": F.lit(Z95) * std_error(f)}[kind]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(f).alias("f"), width.alias("_w"))
    return out.select(
        *by, "n", "f", (F.col("f") + F.col("_w")).alias("high"), (F.col("f") - F.col("_w")).alias("low")
    )


def raw_results(df: DataFrame) -> DataFrame:
    """Distinct results with facilitation and entropy (after ``join_entropy``)."""
    return df.withColumn("facilitation", facilitation()).select(
        *PAIR_KEYS, "category", "constraint", "model", "context_type", "entropy", "facilitation"
    ).distinct()
