"""Table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    mode: str = "error",
) -> None:
    """Write a result folder; Parquet by default, CSV with a header line for exchange.

    ``partition_by`` (model, scenario, ...) lets later reads skip whole experiment cells; ``overwrite`` then replaces only
    the partitions that the rows are in.
    """
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)
