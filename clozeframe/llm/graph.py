"""Connected components of a link table, by alternating star contraction.

Every round rewires each link's larger end to the smallest neighbour of its smaller end (large star), then every node's smaller
neighbours to the smallest of them (small star), until nothing changes: a number of rounds that grows with the
logarithm of the longest path.  Minima are combined before the shuffle and kept as tables, so that
the joins with links of a much-linked node are between plain tables, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import kept


def _directed(links: DataFrame, one: str, other: str) -> DataFrame:
    return (
        links.where(F.col(one) != F.col(other))
        .select(F.greatest(one, other).alias("hi"), F.least(one, other).alias("lo"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link in columns ``a, b``; root is the smallest node of its component.

    NULL ends and links to itself are ignored; a link may be given often and in both directions.
    """
    links = kept(_directed(links, "a", "b"))
    state = None
    while True:
        count = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if count[0] == 0 or tuple(count) == state:
            break
        state = tuple(count)
        both = links.select(F.col("lo").alias("node"), F.col("hi").alias("near")).unionByName(
            links.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
        )
        least = kept(both.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least")))
        large = links.join(least, F.col("lo") == F.col("node")).select("hi", F.col("least").alias("lo"))
        large = kept(large.where("hi <> lo").distinct())
        least = kept(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")))
        small = large.join(least, F.col("hi") == F.col("node"))
        links = kept(
            _directed(
                small.select(F.explode(F.array(F.struct(F.col("hi").alias("x"), "least"), F.struct(F.col("lo").alias("x"), "least"))).alias("l"))
                .select("l.x", "l.least"),
                "x",
                "least",
            )
        )
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
