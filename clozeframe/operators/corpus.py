"""Corpus preparation: token tables, vocabulary, carrier sentences, per-target samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.functions import text
from clozeframe.operators.joins import BROADCAST_BYTES, lookup_join, measured_bytes, small_table
from clozeframe.session import computed_once

# Targets never used as carriers, sample size and seed.
STOP_TARGETS = ["am"]
SAMPLE_SIZE = 10
SEED = 1234

# Frequent keys whose late rows are left out before a sample is sorted; their list is broadcast.
CUT_KEYS = 200_000


def tokenize(df: DataFrame, col: str = "sentence", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, text.tokens(col))


def word_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token, n over all sentences."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def select_carriers(
    sents: DataFrame, lex: DataFrame, tokens: str = "tokens", dedupe: bool = False, salts: int = 1
) -> DataFrame:
    """Sentences that hold a lexicon target exactly once: all sentence columns plus ``target``.

    The exactly-once test is local to the sentence; only its once-words meet the lexicon, in a hash
    join.  A target repeated in the lexicon repeats its sentences unless ``dedupe``: the lexicon is
    reduced to one row per target with a repeat count, and the repeats are written out after the join.
    """
    targets = small_table(_target_copies(lex))
    joined = lookup_join(_once_words(sents, tokens), targets, ["target"], "inner", salts)
    return joined.drop("_copies") if dedupe else _repeated(joined)


def _once_words(sents: DataFrame, tokens: str) -> DataFrame:
    once = sents.withColumn("target", F.explode(text.singletons(tokens)))
    return once.where(~F.col("target").isin(STOP_TARGETS))


def _target_copies(lex: DataFrame) -> DataFrame:
    return lex.groupBy("target").agg(F.count(F.lit(1)).alias("_copies"))


def _repeated(joined: DataFrame) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return joined.withColumn("_copy", copies).drop("_copy", "_copies")


def carrier_counts(carriers: DataFrame) -> DataFrame:
    """word, n: carrier sentences per target."""
    return carriers.groupBy(F.col("target").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def carrier_stats(carriers: DataFrame) -> DataFrame:
    """Mean and minimum number of carriers over targets that have any."""
    return carrier_counts(carriers).agg(
        F.avg("n").alias("mean_sentences"), F.min("n").alias("min_sentences")
    )


def _pick(key: str, ids: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key, *[F.col(c).cast("string") for c in ids]).cast("binary"))


def _early_rows(df: DataFrame, key: str, ids: list[str], n: int, seed: int) -> DataFrame:
    """Rows that may be among the first n of their key: nothing that belongs to the sample is left out.

    The level of a row is the number of binary digits of its hash, so lower levels come first in hash order.  Rows are counted
    per key and level, with map-side combining, and a key's rows above the first level that completes n rows are dropped where
    they are.  Only the keys with most rows are cut, as many as a broadcast holds.
    """
    level = F.length(F.bin(F.conv(F.substring(_pick(key, ids, seed), 1, 15), 16, 10).cast("bigint")))
    counts = df.groupBy(key, level.alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(key)
    upto = F.sum("_n").over(group.orderBy("_level").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(group)})
    last = F.min(F.when(F.col("_upto") >= n, F.col("_level"))).alias("_last")
    cuts = computed_once(summed.groupBy(key).agg(last, F.max("_all").alias("_all")).where(F.col("_all") > n))
    floors = [n * 4**k for k in range(24)]
    sizes = cuts.agg(*[F.count_if(F.col("_all") > floor) for floor in floors]).first()
    floor = next((f for f, size in zip(floors, sizes, strict=True) if size <= CUT_KEYS), floors[-1])
    cut = F.broadcast(cuts.where(F.col("_all") > floor).select(F.struct(key).alias("_key"), "_last"))
    marked = df.select("*", F.struct(key).alias("_key"), level.alias("_level")).join(cut, "_key", "left")
    return marked.where(F.col("_last").isNull() | (F.col("_level") <= F.col("_last"))).drop("_key", "_level", "_last")


def _first_rows(df: DataFrame, key: str, ids: list[str], n: int, seed: int) -> DataFrame:
    window = Window.partitionBy(key).orderBy(_pick(key, ids, seed), *[F.col(c) for c in ids])
    return df.withColumn("_pick", F.row_number().over(window)).where(F.col("_pick") <= n).drop("_pick")


def sample_per_key(
    df: DataFrame, key: str, ids: list[str], n: int = SAMPLE_SIZE, seed: int = SEED
) -> DataFrame:
    """At most n rows per key, without replacement, the same rows on every run.

    Rows are ordered by a seeded hash of their id columns.  A frequent key is cut to about twice n rows before anything is sorted
    or moved, so the rows of a key that are not sampled cost a count and no shuffle.
    """
    return _first_rows(_early_rows(df, key, ids, n, seed), key, ids, n, seed)


def sample_carriers(
    sents: DataFrame, lex: DataFrame, ids: list[str], tokens: str = "tokens", n: int = SAMPLE_SIZE, seed: int = SEED
) -> DataFrame:
    """``sample_per_key`` of the carriers by target.

    A sentence is a row of every target in it, so only rows that may be sampled keep their sentence when they move: words are
    sampled before they meet a lexicon that is too large for a broadcast, and before its repeats are written out.
    """
    once = _once_words(sents, tokens)
    targets = computed_once(_target_copies(lex))
    if measured_bytes(targets) <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
        once = lookup_join(once, targets.select("target"), ["target"], "left_semi")
    sampled = lookup_join(sample_per_key(once, "target", ids, n, seed), targets, ["target"])
    return _first_rows(_repeated(sampled), "target", ids, n, seed)
