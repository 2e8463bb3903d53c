"""CSV and text scans.  Schemas are explicit, so no scan runs twice to infer one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from clozeframe.functions.measures import ColumnLike, as_column
from clozeframe.sources import schemas


# Markers of a missing number.
NO_NUMBER = ["", "NA", "NaN", "nan"]


def number(name: str, kind: DataType) -> Column:
    """A number read as text: known markers are NULL, any other text that is no number is an error."""
    text = F.trim(F.col(name))
    value = F.coalesce(
        text.try_cast("double"), F.raise_error(F.concat(F.lit(f"no number in column {name}: "), text)).cast("double")
    )
    return F.when(text.isNotNull() & ~text.isin(NO_NUMBER), value).cast(kind).alias(name)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    glob: str | None = None,
    file: bool = False,
    by_header: bool = False,
    na_text: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header line; ``file`` adds the source path.

    Numbers are read as text and cast (``number``), because the reader knows one null marker only.  ``by_header`` takes the
    columns by their names in the header, in any order, and fails if one is missing or files differ; without it they are
    taken by position.  ``na_text`` reads ``NA`` as NULL in text columns too.  ``multi_line`` accepts line breaks in quotes, but
    then a file is not split among tasks.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if by_header:
        reader = reader.option("enforceSchema", False)
    else:
        reader = reader.schema(StructType([StructField(f.name, StringType(), True) for f in schema.fields]))
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def value(f: StructField) -> Column:
        if not isinstance(f.dataType, StringType):
            return number(f.name, f.dataType)
        return F.nullif(F.col(f.name), F.lit("NA")).alias(f.name) if na_text else F.col(f.name)

    origin = [F.col("_metadata.file_path").alias("file")] if file else []
    return reader.csv(path).select(*origin, *map(value, schema.fields))


def read_stimuli(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """target, related, unrelated, relation, context."""
    return read_csv(spark, path, schemas.STIMULI)


def read_legacy_stimuli(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """category, constraint and the three ready-made contexts."""
    return read_csv(spark, path, schemas.LEGACY_STIMULI)


def read_contexts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct contexts with constraint and category, the context column named ``context``."""
    return read_csv(spark, path, schemas.UNIQUE_CONTEXTS).withColumnRenamed("isolated_context", "context")


def read_lexicon(spark: SparkSession, path: str | list[str], schema: StructType = schemas.LEXICON) -> DataFrame:
    """By header; ``NA`` is a missing value in every column."""
    return read_csv(spark, path, schema, by_header=True, na_text=True)


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Redistribute by key when the scan gives fewer partitions than ``tasks`` (default: the cores).

    That happens with a few small files; large inputs come in many partitions and stay where they are.
    """
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *keys) if df.rdd.getNumPartitions() < tasks else df


def sentences_from_text(df: DataFrame, text: ColumnLike, *keys: str) -> DataFrame:
    """One row per non-empty line: keys, line number from 0, sentence."""
    return df.select(
        *keys, F.posexplode(F.split(as_column(text), "\n")).alias("line", "sentence")
    ).where(F.length("sentence") > 0)


def read_sentences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per non-empty line of the text files, with file, block and a sentence id.

    The id hashes file, block and text; equal lines of one block share it, and count as one sentence
    only where an operator asks for distinct sentences.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), "value").alias("sent_id"),
        F.col("value").alias("sentence"),
    )


def read_results(
    spark: SparkSession,
    path: str | list[str],
    glob: str | None = "*_10.csv",
    schema: StructType = schemas.LEGACY_PRIMING_RESULT,
) -> DataFrame:
    """All matching result files in one scan, by header, with a ``file`` column for provenance; ``NA`` is missing."""
    return read_csv(spark, path, schema, glob, file=True, by_header=True, na_text=True)


def read_fix_results(spark: SparkSession, path: str | list[str], glob: str | None = "*.csv") -> DataFrame:
    """Before/after result files, whose constraint is a word."""
    return read_results(spark, path, glob, schemas.FIX_RESULT)


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns missing in one frame are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
