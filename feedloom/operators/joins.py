"""Joins of a large table with a side expected to be small."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.session import stored

BROADCAST_ROWS = 1_000_000


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Broadcast ``small`` only once its rows are written and counted; a larger side is joined by shuffle, where AQE
    splits skewed keys. Give ``small`` slim columns: the bound is a row count."""
    small = stored(small)
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


SMALL_BYTES = 256 << 20


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input that sits in too few file splits over all cores before heavy per-row work.

    Anything larger keeps its scan partitions: there the splits already outnumber the cores and a shuffle would only
    move the bodies.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if size <= SMALL_BYTES else df
