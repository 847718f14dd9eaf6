"""Physical-plan helpers: partition balance, prefix sums.

These only *declare* partitioning and hints; Catalyst and AQE still pick the
join algorithms and coalesce partitions at runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reviewlake.session import stage_table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition the rows that CPU-heavy stages read, into as many
    partitions as the session's shuffles have (two per core at least)."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def least_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of rows with equal keys the least by the other columns
    (an ordered winner, summed up before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__least")).select(*keys, "__least.*").select(*df.columns)


def grouped_prefix_sum(df: DataFrame, group: list[str], key: str, value: str, out: str,
                       tie: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` within ``group`` ordered by (``key``, ``tie``).

    A window over a whole group would put a hot group (one title with a third
    of all reviews, or the global order when ``group`` is empty) into one
    task. Instead the rows are range-partitioned in that order, whatever the
    keys look like, and written once with their partition number; each
    partition has its own running sum, and adds the sums of the partitions
    before it (a table with a row per partition and group in it).
    """
    order = [*group, key, *(tie or [])]
    d = stage_table(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    w = W.partitionBy("__part", *group).orderBy(key, *(tie or [])).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = F.sum(value).over(w)
    if not inclusive:
        local = local - F.col(value)
    before = (W.partitionBy(*group) if group else W.partitionBy()).orderBy("__part") \
        .rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*group, "__part").agg(F.sum(value).alias("__sum")).select(
        *group, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return d.withColumn("__local", local).join(totals, [*group, "__part"]).select(
        *df.columns, (F.col("__local") + F.col("__before")).cast("long").alias(out))
