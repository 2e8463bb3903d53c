"""Text statistics as column expressions, one pass over each text and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import bind, words

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"


def _long(value: Column) -> Column:
    return value.cast("long")


def _count(text: Column, pattern: str) -> Column:
    return _long(F.length(text) - F.length(F.regexp_replace(text, pattern, "")))


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    A window becomes one long: low bits of its hash above the bits of its position.  Sorting brings equal
    windows together; with n words 64 - log2(n) bits of the hash are compared.  The positions of windows that
    have an equal neighbour are sorted again, and each covers up to three words not covered by the next one.
    """
    size = F.size(tokens)

    def packed(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        windows = F.slice(w, F.lit(1), F.size(w) - 2)
        return F.struct(
            bits.alias("bits"),
            F.sort_array(
                F.transform(
                    windows,
                    lambda x, i: F.call_function(
                        "shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits
                    ).bitwiseOR(i.cast("long")),
                )
            ).alias("keys"),
        )

    def positions(s: Column) -> Column:
        keys, bits = s["keys"], s["bits"]
        window = lambda at: F.call_function("shiftright", at, bits)
        equal = F.filter(
            keys,
            lambda x, k: F.coalesce(window(x) == window(F.get(keys, k - 1)), F.lit(False))
            | F.coalesce(window(x) == window(F.get(keys, k + 1)), F.lit(False)),
        )
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.sort_array(F.transform(equal, lambda x: x.bitwiseAND(mask)))

    def covered(at: Column) -> Column:
        ahead = F.transform(at, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, k + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(ahead, F.lit(0).cast("long"), lambda total, x: total + x)

    found = bind(tokens, lambda w: bind(packed(w), lambda s: bind(positions(s), covered)))
    return F.when(size < 4, F.lit(0).cast("long")).otherwise(found)


def with_statistics(docs: DataFrame, wide: bool = False) -> DataFrame:
    """``docs`` with an added struct column ``stats``; NULL text counts as empty.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words; with ``wide`` also counts that only the
    quality rules use: distinct words, capitals, digits, full stops, commas, the longest word.
    """
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text.alias("_text"), words(F.col("text")).alias("_words"), lines.alias("_lines")
    )
    tokens = F.col("_words")
    stats = [
        _long(F.size(tokens)).alias("n_words"),
        _long(F.length("_text") - F.length(_bare(F.col("_text")))).alias("_spaces"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _long(F.size("_lines")).alias("n_lines"),
        _long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        repeated_words(tokens).alias("n_repeat_words"),
        _long(F.length("_text")).alias("_length"),
    ]
    if wide:
        stats += [
            _long(F.size(F.array_distinct(tokens))).alias("n_distinct"),
            _count(F.col("_text"), r"\p{Lu}").alias("n_capitals"),
            _count(F.col("_text"), r"\p{Nd}").alias("n_digits"),
            _count(F.col("_text"), r"\.").alias("n_stops"),
            _count(F.col("_text"), ",").alias("n_commas"),
            _long(F.coalesce(F.array_max(F.transform(tokens, lambda w: F.length(w))), F.lit(0))).alias("longest_word"),
        ]
    counted = base.select("_row", F.struct(*stats).alias("_s"))
    rest = ["n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    if wide:
        rest += ["n_distinct", "n_capitals", "n_digits", "n_stops", "n_commas", "longest_word"]
    result = F.struct(F.col("_s.n_words"), (F.col("_s._length") - F.col("_s._spaces")).alias("word_chars"), *[F.col(f"_s.{c}") for c in rest])
    return counted.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], result.alias("stats"))


def _bare(text: Column) -> Column:
    """The text without ASCII white space."""
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
