"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, what: str = "components", most: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b): root is the
    least node of its component.  Each step only takes minima per node (summed
    up before the shuffle, and written) and joins them back, so a node with
    very many edges can be split among tasks by the skew join; steps end when
    the edges no longer change."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), what)
    last = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), what)
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large, what)
        low = written(large.groupBy("b").agg(F.min("a").alias("m")), what)
        small = large.join(low, "b")
        e = written(small.select(F.col("m").alias("x"), F.col("a").alias("y"))
                    .unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
                    .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), what)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
