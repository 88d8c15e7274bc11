"""Running sums within keys of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_in_windows(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """What running_sum gives, each key sorted in one task: for keys that are known to be small."""
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def running_sum(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], value: Column, name: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with `name`: the sum of `value` over the rows of their key up to each, in ascending order.

    Rows are cut into ranges of key and order, so that a key with most of the rows is many ranges' work: sums
    inside a range, and those of the key's earlier ranges, of which there are as many as shuffle partitions.
    `save` writes the cut rows and reads them back, so that the ranges stay what they are. Rows of a key that
    are equal in `order` take an order of their own among themselves. Null keys are a key, nulls come first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = save(rows.withColumn("_value", value).repartitionByRange(parts, *key, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy(*key, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(key)), F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"_{i}"))
    summed = cut.withColumn(name, F.sum("_value").over(inside)).join(shift, same)
    return summed.select(*rows.columns, (F.col(name) + F.col("_before")).alias(name))
