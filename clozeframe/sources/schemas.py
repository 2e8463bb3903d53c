"""Explicit schemas of every file the experiments read or write.

Column names and their order are fixed values: the files are read by position.
"""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def _fields(names: list[str], kind) -> list[StructField]:
    return [StructField(n, kind(), True) for n in names]


STIMULI = StructType(_fields(["target", "related", "unrelated", "relation", "context"], StringType))

CONTEXT_NAMES = ["isolated_context", "related_context", "unrelated_context"]
PRIME_NAMES = ["target", "related", "unrelated"]
CONDITIONS = ["isolated", "related", "unrelated"]
PRIME_CONDITIONS = ["rp_isolated", "rp_related"]

LEGACY_STIMULI = StructType(
    [StructField("category", IntegerType(), True), StructField("constraint", DoubleType(), True)]
    + _fields(PRIME_NAMES + CONTEXT_NAMES, StringType)
)

UNIQUE_CONTEXTS = StructType(
    [
        StructField("isolated_context", StringType(), True),
        StructField("constraint", DoubleType(), True),
        StructField("category", IntegerType(), True),
    ]
)

STORY_LEXICON = StructType(
    _fields(["association", "target", "related", "unrelated", "relation1", "relation2"], StringType)
    + _fields(["delta_200ms", "delta_1200ms"], DoubleType)
    + _fields(["pos"], StringType)
)

LEXICON = StructType(
    _fields(["target", "prime", "unrelated", "relation", "context_word"], StringType)
    + _fields(["delta_200ms", "delta_1200ms"], DoubleType)
)


def _metric_fields(conditions: list[str], best: bool) -> list[StructField]:
    kinds = [("probability", DoubleType), ("rank", IntegerType)]
    if best:
        kinds += [("argmax", StringType), ("maxprob", DoubleType)]
    return [StructField(f"{c}_{name}", kind(), True) for c in conditions for name, kind in kinds]


PRIMING_RESULT = StructType(
    _fields(PRIME_NAMES + ["relation", "context", "related_context", "unrelated_context"], StringType)
    + _metric_fields(CONDITIONS, best=True)
    + _metric_fields(PRIME_CONDITIONS, best=False)
)

LEGACY_PRIMING_RESULT = StructType(LEGACY_STIMULI.fields + _metric_fields(CONDITIONS, best=False))

# Before/after files hold the constraint as a word.
FIX_RESULT = StructType(
    [StructField(f.name, StringType() if f.name == "constraint" else f.dataType, True) for f in LEGACY_PRIMING_RESULT.fields]
)

CONSTRAINT_RESULT = StructType(STIMULI.fields + _fields(["constraint", "entropy"], DoubleType))

ENTROPY_RESULT = StructType(_fields(["context"], StringType) + _fields(["constraint", "entropy"], DoubleType))
