"""Text labels used in published tables, and recodings of file-name parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clozeframe.functions.measures import ColumnLike, as_column

# Spelling of lexical relations after normalisation.
UNCLASSIFIED = "unclassified"
ANTONYM = "antonym"
PHRASAL_RELATIONS = {
    "fpa": "forward phrasal associate",
    "bpa": "backward phrasal associate",
}

# Data-set variants of the before/after comparison, in display order.
FIX_LABELS = {"polysemy_free": "After Fix"}
FIX_DEFAULT = "Before Fix"
FIX_ORDER = ["Before Fix", "After Fix"]

# Names of the priming criteria in reports.
CRITERION_LABELS = {
    "pre": "F > 0",
    "post": "F > 0 and P(T | R, C) > P(T | C)",
    "post2": "F > 0 and RF > 0",
}
DISTRACTION_LABELS = {
    "facilitated": "P(T | R) > P(T | U)",
    "worse": "P(T | R) < P(T)",
}


def recode(c: ColumnLike, labels: dict[str, str], default: Column | None = None) -> Column:
    """Dictionary recoding; values outside the dictionary keep ``default``."""
    c = as_column(c)
    out = None
    for value, label in labels.items():
        out = (F if out is None else out).when(c == value, F.lit(label))
    return out.otherwise(default) if default is not None else out


def normalise_relation(c: ColumnLike, variant: str = "five") -> Column:
    """Lower-cased relation with spelling variants merged.

    ``five`` also spells out the two phrasal relations; ``three`` leaves them as they are.
    NULL stays NULL.
    """
    if variant not in ("five", "three"):
        raise ValueError(f"unknown relation variant: {variant!r}")
    low = F.lower(as_column(c))
    out = F.when(F.contains(low, F.lit("uncl")), F.lit(UNCLASSIFIED)).when(
        F.contains(low, F.lit("anton")), F.lit(ANTONYM)
    )
    if variant == "five":
        for short, full in PHRASAL_RELATIONS.items():
            out = out.when(low == short, F.lit(full))
    return out.otherwise(low)


def fix_label(dataset: ColumnLike) -> Column:
    """``After Fix`` for the cleaned data set, ``Before Fix`` for anything else, NULL included."""
    return recode(dataset, FIX_LABELS, F.lit(FIX_DEFAULT))


def level_ordinal(c: ColumnLike, levels: list[str]) -> Column:
    """Position (from 0) of a label in its display order; NULL for unknown labels."""
    c = as_column(c)
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), c), F.lit(0)).cast("int") - 1


def fmt_count(label: ColumnLike, n: ColumnLike, space: bool = True) -> Column:
    """``label (n)``, or ``label(n)`` without the blank."""
    return F.concat(
        as_column(label), F.lit(" (" if space else "("), as_column(n).cast("string"), F.lit(")")
    )


def fmt_strip_count(c: ColumnLike) -> Column:
    """Drop the first parenthesised part and outer blanks."""
    return F.trim(F.regexp_replace(as_column(c), r"^([^(]*)\([^)]*\)", "$1"))


def fmt_title(c: ColumnLike) -> Column:
    return F.initcap(as_column(c))


def fmt_number(c: ColumnLike, digits: int = 2) -> Column:
    """Half-even rounding, shortest text: 4.0 prints as 4 and 6.90 as 6.9."""
    return F.regexp_replace(F.bround(as_column(c), digits).cast("string"), r"\.0$", "")


def fmt_mean_error(mean: ColumnLike, error: ColumnLike, digits: int = 2) -> Column:
    return F.concat(fmt_number(mean, digits), F.lit(r"$\pm$"), fmt_number(error, digits))


def fmt_percent(c: ColumnLike, digits: int = 3) -> Column:
    """Share rounded to four places, printed as a percentage."""
    return F.format_string(f"%.{digits}f%%", F.bround(as_column(c), 4) * F.lit(100.0))
