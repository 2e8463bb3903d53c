"""Cleaning of the prime-target lexicon and the word lists derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.functions.labels import UNCLASSIFIED, normalise_relation
from clozeframe.operators.joins import PAIR_KEYS, exclude, lookup_join

# Targets left out of the before/after comparison.
EXCLUDED_TARGETS = ["yours", "being"]


def clean_lexicon(
    df: DataFrame, variant: str = "five", lower_primes: bool = False, drop: tuple[str, ...] = ("context_word",)
) -> DataFrame:
    """Drop unused columns, name the prime ``related``, remove equal rows, then lower-case.

    Rows that become equal only through lower-casing stay, and fan out later joins.
    """
    df = df.drop(*drop)
    if "prime" in df.columns:
        df = df.withColumnRenamed("prime", "related")
    lowered = {"target": F.lower("target"), "relation": normalise_relation("relation", variant)}
    if lower_primes:
        lowered |= {"related": F.lower("related"), "unrelated": F.lower("unrelated")}
    return df.distinct().withColumns(lowered)


def same_targets(lex: DataFrame) -> DataFrame:
    """Targets with a row whose related and unrelated primes are the same word."""
    return lex.where(F.col("related") == F.col("unrelated")).select("target").distinct()


def problematic_targets(lex: DataFrame, norms: list[str]) -> DataFrame:
    """Targets with a missing norm in any row."""
    missing = F.lit(False)
    for c in norms:
        missing = missing | F.col(c).isNull()
    return lex.where(missing).select("target").distinct()


def exclude_targets(df: DataFrame, lex: DataFrame, norms: list[str], words: list[str] | None = None) -> DataFrame:
    """Leave out a fixed word list and every target with a missing norm; NULL targets stay."""
    words = EXCLUDED_TARGETS if words is None else words
    kept = df.where(F.col("target").isNull() | ~F.col("target").isin(words)) if words else df
    return exclude(kept, problematic_targets(lex, norms))


def classified(df: DataFrame) -> DataFrame:
    """Rows with a known relation."""
    return df.where(F.col("relation").isNotNull() & (F.col("relation") != UNCLASSIFIED))


def relation_counts(lex: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Rows per classified relation.

    With results: distinct (target, related, unrelated, relation) found in them.  The results are
    reduced to distinct triples before they meet the lexicon, so a frequent triple moves once.
    """
    if results is not None:
        triples = results.select(*PAIR_KEYS).distinct()
        lex = lookup_join(triples, lex.select(*PAIR_KEYS, "relation").distinct(), PAIR_KEYS)
    return classified(lex).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def single_piece(lex: DataFrame, vocab: DataFrame, piece: str = "token") -> DataFrame:
    """Lexicon rows whose target is one vocabulary entry."""
    pieces = vocab.select(F.col(piece).alias("target")).distinct()
    return lookup_join(lex, pieces, ["target"], "left_semi")
