"""Rows in order of their keys, cut into ranges that are stored before anything refers to them.

The bounds of a range shuffle come from a sample. Two branches that refer to it may become two shuffles, each
with bounds and merged partitions of its own, so a number of a partition means nothing until it is a column
of a written table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(df: DataFrame, order: list[Column | str], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with _range, the number of the range of the order that holds them; equal keys share one."""
    return store(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[Column | str], name: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with their place in the whole order, from 0: places in each range and the rows of ranges before it."""
    rows = ranged(df, order, store)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    skip = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_skip"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_skip")
    return rows.join(F.broadcast(skip), "_range").withColumn(name, place.cast("long")).drop("_range", "_skip")
