"""Rows dealt over all cores before work that costs much a row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, lots: int = 2) -> DataFrame:
    """The same rows in `lots` partitions a core: a small file is one split, a sheet one window, however much each row costs."""
    return rows.repartition(lots * rows.sparkSession.sparkContext.defaultParallelism)
