"""The row before a row within its group, for groups of any size.

A plain window puts a whole group into one task.  Here a group is cut into buckets of its order; a window runs within a
bucket, and only the first row of each bucket looks into the table of bucket ends, which is smaller by the bucket's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, carry: list[str], name: str = "previous") -> DataFrame:
    """Add a struct of the ``carry`` columns of the row before (null for a group's first row).

    ``bucket`` must not fall as ``order`` rises and not be null; ties in ``order`` are broken by the carried values.
    """
    at = [*order, *[c for c in carry if c not in order]]
    x = df.withColumn("_bucket", bucket)
    row = F.struct(*[F.col(c) for c in at])
    w = Window.partitionBy(*keys, "_bucket").orderBy(*at)
    x = x.withColumn("_near", F.lag(F.struct(*carry)).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = x.groupBy(*keys, "_bucket").agg(F.max(row).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    ends = last.select(*keys, "_bucket", F.lag("_last").over(over).alias("_end"))
    x = x.join(ends, [*keys, "_bucket"])
    far = F.struct(*[F.col(f"_end.{c}").alias(c) for c in carry])
    return x.withColumn(name, F.when(~F.col("_first"), F.col("_near")).when(F.col("_end").isNotNull(), far)).drop("_bucket", "_near", "_first", "_end")


def with_rank(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Add ``rank`` (0-based position in the group's order) and ``group_n`` (rows of the group), for groups of any size.

    ``bucket`` must not fall as ``order`` rises.  Rows count within their bucket; buckets are offset by the counts before.
    """
    x = df.withColumn("_bucket", bucket)
    sizes = x.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.coalesce(F.sum("_c").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_c").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = sizes.select(*keys, "_bucket", before.alias("_before"), total.alias("group_n"))
    x = x.withColumn("_here", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    return x.join(offsets, [*keys, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_here")).drop("_bucket", "_here", "_before")
