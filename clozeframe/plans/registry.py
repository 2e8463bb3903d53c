"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from clozeframe.plans.views import Views, compose

DIGITS = 6


@dataclass(frozen=True)
class Query:
    build: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return rounded(self.build(Views(spark, folder)))


QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six places without negative zero: engines sum in different orders."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), DIGITS) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(sql: str | None = None, doubles: str = ""):
    """Register a query under the function's name; ``doubles`` lists the SQL columns to round."""
    if sql is not None:
        sql = compose(sql)
        if doubles:
            replaced = ", ".join(f'round("{c}", {DIGITS}) + 0.0::double as "{c}"' for c in doubles.split())
            sql = f"select * replace ({replaced}) from ({sql})"

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[build.__name__] = Query(build, sql)
        return build

    return register
