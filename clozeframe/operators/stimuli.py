"""Construction of primed cloze stimuli and of the run matrix.  All row-local, nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozeframe.functions import text
from clozeframe.functions.measures import ColumnLike

CONDITIONS = ["isolated", "related", "unrelated"]


def _prime(context: ColumnLike, word: ColumnLike, mode: str | Column) -> Column:
    if isinstance(mode, str):
        return text.prime(context, word, mode)
    out = None
    for name in text.PRIME_TEMPLATES:
        out = (F if out is None else out).when(mode == name, text.prime(context, word, name))
    return out


def build_stimuli(df: DataFrame, mode: str | Column = "word", context: str = "context") -> DataFrame:
    """Adds related_context, unrelated_context and the mask position of all three contexts."""
    primed = df.withColumns(
        {
            "related_context": _prime(context, "related", mode),
            "unrelated_context": _prime(context, "unrelated", mode),
        }
    )
    return primed.withColumns(
        {
            "isolated_mask": text.mask_index(context),
            "related_mask": text.mask_index("related_context"),
            "unrelated_mask": text.mask_index("unrelated_context"),
        }
    )


def conditions_long(stimuli: DataFrame, keys: list[str], context: str = "context") -> DataFrame:
    """One row per stimulus and condition: keys, condition, context, mask_index.

    The masks stay beside what is exploded, so those that nobody reads are not computed.
    """
    names = {"isolated": context, "related": "related_context", "unrelated": "unrelated_context"}
    rows = [F.struct(F.lit(c).alias("condition"), F.col(names[c]).alias("cloze")) for c in CONDITIONS]
    masks = [F.col(f"{c}_mask").alias(f"_mask_{c}") for c in CONDITIONS]
    long = stimuli.select(*keys, *masks, F.explode(F.array(*rows)).alias("_c"))
    mask = F.coalesce(*[F.when(F.col("_c.condition") == c, F.col(f"_mask_{c}")) for c in CONDITIONS])
    return long.select(*keys, "_c.*", mask.alias("mask_index"))


def run_matrix(df: DataFrame, **parameters: list[str]) -> DataFrame:
    """Every row once per combination of the listed parameter values.

    The lists are literals of the experiment, so they are exploded in place; no join is needed.
    """
    for name, values in parameters.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
