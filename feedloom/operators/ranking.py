"""First-n-per-key and ordinals that stay parallel when one key holds a large share of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def salts_for(df: DataFrame) -> int:
    """How many slices a hot key is cut into: one per shuffle partition, at most 256."""
    return min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str],
                rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key, with their exact rank.

    Rows are ranked inside (key, salt) first, so a key with a third of all rows is sorted by many tasks, and at most
    ``n`` rows per salt reach the final rank. Both filters become window group limits, which also cut the rows before
    each shuffle. Give it slim rows: key, order columns and a row id.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts_for(df)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= n)
        .drop(rank, "_salt")
        .withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= n)
    )


def ordinals(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """1-based position of every row within its key.

    ``chunk`` must rise with ``order``. Rows are numbered inside (key, chunk), and a running total over one row per
    chunk gives each chunk its offset, so no key is sorted whole by one task.
    """
    cut = df.withColumn("_chunk", chunk)
    sizes = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_chunk", "_inside", "_offset")
    )
