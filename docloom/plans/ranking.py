"""Positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable


def positions(df: DataFrame, group: list[str], order: list[Column], out: str = "position") -> DataFrame:
    """Zero-based position of each row in its group, in a total ``order``.

    One window per group would sort a hot group in a single task.  Here rows are
    sorted globally, so a large group spans many range partitions; a row's
    position is its offset within its partition plus the number of group members
    in the partitions before.  The sorted rows are made durable because row ids
    must not change between the two uses.
    """
    ordered = df.orderBy(*[F.col(g) for g in group], *order).withColumn("_row", F.monotonically_increasing_id())
    ordered = durable(ordered.withColumn("_part", F.shiftright("_row", 33).cast("int")))
    named = {g: f"_group{n}" for n, g in enumerate(group)}
    renamed = ordered.select(*[F.col(g).alias(n) for g, n in named.items()], F.col("_part").alias("_slice"), "_row")
    slices = renamed.groupBy(*named.values(), "_slice").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    # One row per group and range partition.
    before = W.partitionBy(*named.values()).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    keys = F.col("_part") == F.col("_slice")
    for g, n in named.items():
        keys = keys & F.col(g).eqNullSafe(F.col(n))
    position = (F.col("_row") - F.col("_first") + F.col("_before")).cast("int").alias(out)
    return ordered.join(slices, keys, "inner").select(*df.columns, position)
