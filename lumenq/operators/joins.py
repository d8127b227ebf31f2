"""Joins that Spark has no word for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, columns: list[str]) -> DataFrame:
    """left with the columns of the last row of right at or before it (by ``on``, with equal keys); nulls where there is none.

    Both sides are laid in one order and the last right row is carried on: one shuffle by the keys, streamed, and no pairs.
    Of right rows at one place the one with the largest columns counts; names of columns must not be in left.
    """
    held = F.struct(*(F.col(f"`{c}`") for c in columns))
    a = left.select(*keys, on, F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__row"), F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType).alias("__held"))
    b = right.select(*keys, on, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), held.alias("__held"))
    order = Window.partitionBy(*keys).orderBy(on, F.col("__held").isNull(), "__held").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("__last", F.last("__held", ignorenulls=True).over(order)).where("__row IS NOT NULL")
    return carried.select("__row.*", *(F.col(f"__last.`{c}`").alias(c) for c in columns))


def interval_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs with start <= at < end, all whole numbers: both sides meet by buckets of ``width``, an interval in each that it touches."""
    bucket = F.floor(F.col(at) / width)
    touched = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    a = left.withColumn("__b", bucket)
    b = right.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(touched))
    return a.join(b, "__b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")
