"""Match audits of joins.

Joins themselves carry no hint: the planner broadcasts a side by its size in
bytes, and adaptive execution turns a shuffle join into a broadcast join, or
splits skewed partitions, by what it measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_audit(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows kept vs unmatched when the fact must match the dimension (one job).

    The fact is counted per key first, so a hot key is one row in the join."""
    keys = dim.select(key).distinct().withColumn("_m", F.lit(1))
    counted = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    j = counted.join(keys, key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.agg(total("_n").alias("rows_before"), total(F.when(F.col("_m").isNotNull(), F.col("_n"))).alias("rows_matched"),
                 total(F.when(F.col("_m").isNull(), F.col("_n"))).alias("rows_unmatched"))
