"""Retention: each feed keeps its newest rows; a star exempts a row but still takes a place."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.operators.joins import join_checked
from feedloom.operators.lists import sort_time
from feedloom.operators.ranking import top_per_key
from feedloom.schemas import RETAIN_PER_FEED


def retention(items: DataFrame, cap: int = RETAIN_PER_FEED) -> DataFrame:
    """The rows that stay. Nothing is dropped for having been read.

    Only (feed, time, id) is ranked. The row at place ``cap`` marks each overfull feed's cut, one row per feed, and
    the wide rows are compared with their feed's cut without being sorted or, while the cuts are few, shuffled.
    """
    slim = items.select("feed_id", sort_time().alias("ts"), "item_id")
    ranked = top_per_key(slim, ["feed_id"], [F.col("ts").desc(), F.col("item_id").desc()], cap, ["item_id"])
    cuts = ranked.filter(F.col("rank") == cap).select("feed_id", F.struct("ts", "item_id").alias("cut"))
    kept = (F.col("is_starred") == 1) | F.col("cut").isNull() | (F.struct(sort_time(), "item_id") >= F.col("cut"))
    return join_checked(items, cuts, "feed_id", "left").filter(kept).select(*items.columns)
