"""Joins between result tables and lookups.

Plain lookups carry no hint: Spark broadcasts one when its size estimate, or its measured size during
adaptive execution, is under the configured threshold, and shuffles both sides otherwise.  Estimates
of *derived* lookups (joins, counts over results) are far too high, so the results would be shuffled
before the real size is known; ``small_table`` computes such a lookup once, measures it, and asks for a
broadcast only if it fits.

When both sides are shuffled, one key may hold a large part of the results.  Adaptive execution then
splits the skewed partition; ``salts`` does the same without it, by spreading every key over that many
sub-keys and repeating the lookup rows once per sub-key.  Spark's estimates leave the repeats out, so a salted
join asks for a shuffle of both sides: the repeats are never collected for a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.session import computed_once

PAIR_KEYS = ("target", "related", "unrelated")


# Largest measured lookup that is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of all values as text plus a fixed share per value, from one aggregate."""
    per_value = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(16) for c in df.columns]
    return df.agg(F.sum(reduce(lambda a, b: a + b, per_value).cast("bigint"))).first()[0] or 0


def small_table(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A lookup computed once (checkpointed), marked for broadcast if its measured size is within the limit."""
    kept = computed_once(df)
    return F.broadcast(kept) if measured_bytes(kept) <= limit else kept


def natural_join(facts: DataFrame, lookup: DataFrame, on: tuple[str, ...] | list[str], salts: int = 1) -> DataFrame:
    """Inner join on named keys in which NULL matches NULL: the keys are compared as a struct."""
    key = F.struct(*[F.col(k) for k in on]).alias("_key")
    rest = [F.col(c) for c in lookup.columns if c not in on]
    return lookup_join(facts.select("*", key), lookup.select(key, *rest), ["_key"], "inner", salts).drop("_key")


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: tuple[str, ...] | list[str], how: str = "inner", salts: int = 1
) -> DataFrame:
    """Equi-join of facts to a lookup on named keys (``inner``, ``left``, ``left_semi``, ``left_anti``); NULL keys match nothing."""
    on = list(on)
    if salts <= 1:
        return facts.join(lookup, on, how)
    # The salt depends on the row and its partition only, so a re-run task assigns it again the same
    # way, and copies of one row still spread over sub-keys.
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in facts.columns]), F.lit(salts))
    salted = facts.withColumn("_salt", salt.cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), on + ["_salt"], how).drop("_salt")


# Bits of a bitmap of keys: sixteen per key, at most 2**28 (32 MB); a broadcast row holds 1024 words of 64.
MOST_BITS = 28


def probable_members(df: DataFrame, keys: DataFrame, on: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows whose key is listed, and a few others, whose key shares the bit of a listed one; no row moves.

    The bits are put together by the executors, whatever the number of keys; many more than 2**28 keys leave hardly a row out.
    """
    bits = 1 << min(MOST_BITS, max(16, (16 * keys.count()).bit_length()))
    at = F.xxhash64(*on).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    ones = keys.select(F.shiftright(at, 6).alias("_word"), one.alias("_bits"))
    every = df.sparkSession.range(bits >> 6).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_bits"))
    words = ones.unionByName(every).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    in_order = F.array_sort(F.collect_list(F.struct("_word", "_bits")))
    blocks = words.groupBy(F.shiftright("_word", 10).alias("_block")).agg(F.transform(in_order, lambda w: w["_bits"]).alias("_map"))
    word = F.get("_map", F.shiftright("_at", 6).bitwiseAND(F.lit(1023)).cast("int"))
    found = F.getbit(word, F.col("_at").bitwiseAND(F.lit(63)).cast("int")) == 1
    here = df.withColumn("_at", at)
    return here.join(F.broadcast(blocks), (F.shiftright("_at", 16) == F.col("_block")) & found, "left_semi").drop("_at")


# A key is hot if it has more than this share of the rows of an average partition; at most so many keys are looked at.
HOT_SHARE, HOT_KEYS = 1.0, 100


def hot_keys(facts: DataFrame, on: tuple[str, ...] | list[str]) -> list[int]:
    """Hashes of the keys with more rows than an average shuffle partition, by a mergeable sketch of frequent items.

    The sketch never counts a frequent key too low by more than its resolution, and takes a bounded size whatever the number
    of keys.  A key that only seems hot costs a few repeated lookup rows.
    """
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = F.expr(f"approx_top_k(_k, {HOT_KEYS}, {100 * HOT_KEYS})")
    row = facts.select(F.xxhash64(*on).alias("_k")).agg(top.alias("top"), F.count("*").alias("n")).first()
    return [r["item"] for r in row["top"] or [] if r["count"] * parts > HOT_SHARE * row["n"]]


def split_join(facts: DataFrame, lookup: DataFrame, on: tuple[str, ...] | list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``lookup_join`` in which only the hot keys of the facts are spread over ``salts`` sub-keys.

    Lookup rows of hot keys are repeated once per sub-key, all others stay single, so nothing else grows.
    """
    on = list(on)
    hot = hot_keys(facts, on)
    if not hot:
        return lookup_join(facts, lookup, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in facts.columns]), F.lit(salts))
    salted = facts.withColumn("_salt", F.when(is_hot, salt).otherwise(0).cast("int"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    repeated = lookup.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def join_on_group(df: DataFrame, per_group: DataFrame, by: list[str]) -> DataFrame:
    """Attach per-group values to every row of the group.

    The key is compared as a struct, in which NULL equals NULL, as it does in a group-by.
    """
    if not by:
        return attach_single_row(df, per_group)
    key = F.struct(*[F.col(k) for k in by]).alias("_key")
    values = [c for c in per_group.columns if c not in by]
    return df.select("*", key).join(per_group.select(key, *values), "_key").drop("_key")


def attach_single_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate through a scalar subquery."""
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_one")).scalar()
    return df.withColumn("_one", packed).select(
        *df.columns, *[F.col(f"_one.{c}").alias(c) for c in one_row.columns]
    )


def exclude(df: DataFrame, keys: DataFrame, on: str | list[str] = "target", salts: int = 1) -> DataFrame:
    """Rows whose key is not listed; rows with a NULL key stay."""
    on = [on] if isinstance(on, str) else list(on)
    return lookup_join(df, keys.select(*on).distinct(), on, "left_anti", salts)


def keep_members(df: DataFrame, keys: DataFrame, on: str | list[str] = "relation", salts: int = 1) -> DataFrame:
    """Rows whose key is listed."""
    on = [on] if isinstance(on, str) else list(on)
    return lookup_join(df, keys.select(*on).distinct(), on, "left_semi", salts)


def join_lexicon(
    results: DataFrame, lex: DataFrame, on: tuple[str, ...] = PAIR_KEYS, salts: int = 1
) -> DataFrame:
    """Attach the relation of each (target, related, unrelated); repeated lexicon rows repeat results."""
    return natural_join(results, lex.select(*on, "relation"), on, salts)


def join_norms(
    results: DataFrame, lex: DataFrame, norms: list[str], on: tuple[str, ...] = PAIR_KEYS, salts: int = 1
) -> DataFrame:
    """Results with one row per norm task: columns ``task`` and ``delta``.

    The join moves each result once; the fan-out to tasks happens after it.
    """
    joined = natural_join(results, lex.select(*on, "relation", *norms), on, salts)
    return joined.unpivot([c for c in joined.columns if c not in norms], norms, "task", "delta")


def attach_counts(df: DataFrame, top: DataFrame, on: str = "relation") -> DataFrame:
    """Keep rows of the listed relations and attach their count ``n``.

    Relations are few and frequent: pass ``top`` through ``small_table`` before joining it to results.
    """
    return natural_join(df, top.select(on, "n"), [on])


def counted_relations(lex: DataFrame, counts: DataFrame) -> DataFrame:
    """Lexicon pairs of the counted relations with their count, ready to join to results."""
    return small_table(attach_counts(lex.select(*PAIR_KEYS, "relation"), counts))


CONSTRAINT_KEYS = ("target", "related", "unrelated", "relation", "context")


def join_constraint(
    results: DataFrame, scores: DataFrame, on: tuple[str, ...] = CONSTRAINT_KEYS, salts: int = 1
) -> DataFrame:
    """Attach the constraint score of each stimulus; a missing relation matches a missing one."""
    return natural_join(results, scores.select(*on, "constraint"), on, salts)


def join_entropy(
    results: DataFrame,
    contexts: DataFrame,
    context: str = "isolated_context",
    constraint: str | None = "constraint",
    salts: int = 1,
) -> DataFrame:
    """Attach the entropy of each isolated context.

    With a constraint column on both sides it is part of the key, compared at 12 decimals because
    the two sides may have been written and read back.
    """
    if constraint is None:
        return natural_join(results, contexts.select(context, "entropy"), [context], salts)
    facts = results.withColumn("_constraint_key", F.round(constraint, 12))
    lookup = contexts.select(context, F.round(constraint, 12).alias("_constraint_key"), "entropy")
    return natural_join(facts, lookup, [context, "_constraint_key"], salts).drop("_constraint_key")
