"""Running numbers and carried values along long keys.

A window partitioned by a key puts all rows of that key in one task. Here a key's rows are first
cut into consecutive buckets along the order; the window runs inside a bucket, and only one row
per bucket is windowed along the whole key. ``bucket`` must never fall as the order rises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _matching(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left")


def number_along(df: DataFrame, keys: list[str], order_by: list[str | Column], bucket: Column,
                 name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within ``keys`` along ``order_by``. Keys must not be null."""
    return total_before(df, keys, order_by, bucket, F.lit(1), name)


def total_before(df: DataFrame, keys: list[str], order_by: list[str | Column], bucket: Column,
                 amount: Column, name: str, light: bool = False) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the earlier rows of the same key, 0 for the first.

    The bucket totals come from a second, map-side combined pass over ``df``. With ``light`` they
    come from the windowed rows themselves: right for rows that hold little but keys and order and
    are costly to make, since both uses then share one shuffle and ``df`` is made once.
    """
    parts = [*keys, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    inside = Window.partitionBy(*parts).orderBy(*order_by)
    local = bucketed.withColumn("_local", F.sum("_amount").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_amount"))
    if light:
        last = Window.partitionBy(*parts).orderBy(*order_by)
        totals = (
            local.withColumn("_later", F.lead("_amount").over(last))
            .filter(F.col("_later").isNull())
            .select(*parts, (F.col("_local") + F.col("_amount")).alias("_total"))
        )
    else:
        totals = bucketed.groupBy(*parts).agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, F.coalesce(F.sum("_total").over(earlier), F.lit(0))
                            .alias("_offset"))
    return (
        _matching(local, offsets, parts)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_bucket", "_amount", "_local", "_offset")
    )


def last_before(df: DataFrame, keys: list[str], order_by: list[str], bucket: Column,
                value: Column, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` of an earlier row of the same key, else null."""
    parts = [*keys, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*parts).orderBy(*order_by) \
        .rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    closing = (
        bucketed.groupBy(*parts)
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order_by)))
             .alias("_closing"))
        .select(*parts, F.last("_closing", ignorenulls=True).over(earlier).alias("_carried"))
    )
    local = bucketed.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return (
        _matching(local, closing, parts)
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_bucket", "_value", "_local", "_carried")
    )
