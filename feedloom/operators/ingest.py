"""From parsed entries to new item rows: skip known Shorts, keep the newest, drop duplicates, ignore what is stored."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions.urls import video_id
from feedloom.operators.ranking import top_per_key
from feedloom.schemas import MAX_ITEMS_PER_POLL, RETAIN_PER_FEED
from feedloom.session import stored

_NEWEST = ("published_at desc nulls last", "feed_pos asc")
_OLDEST = ("published_at asc nulls first", "feed_pos desc")


def _order(spec: tuple[str, ...]) -> list:
    flags = {"desc nulls last": "desc_nulls_last", "asc nulls first": "asc_nulls_first", "asc": "asc", "desc": "desc"}
    return [getattr(F.col(s.split(" ", 1)[0]), flags[s.split(" ", 1)[1]])() for s in spec]


def without_shorts(batch: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drop entries already judged Shorts. Entries that are no video skip the join, so their null key never shuffles."""
    tagged = batch.withColumn("_video", video_id(F.col("url")))
    shorts = verdicts.filter("is_short = 1").select(F.col("video_id").alias("_video"))
    videos = tagged.filter("_video is not null").join(shorts, "_video", "left_anti")
    return tagged.filter("_video is null").unionByName(videos).drop("_video")


def newest_per_poll(batch: DataFrame, keys: list[str], cap: int = min(MAX_ITEMS_PER_POLL, RETAIN_PER_FEED),
                    bounded: bool = False) -> DataFrame:
    """The newest ``cap`` entries of each poll, undated ones last, ties in body order.

    ``bounded`` says that a key's rows come from one response body; otherwise a key may be of any size, slim rows are
    ranked in salted slices and the chosen positions select the wide rows.
    """
    if bounded:
        window = Window.partitionBy(*keys).orderBy(*_order(_NEWEST))
        return batch.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= cap).drop("_rank")
    slim = batch.select(*keys, "published_at", "feed_pos")
    chosen = top_per_key(slim, keys, _order(_NEWEST), cap, ["feed_pos"])
    return batch.join(chosen.select(*keys, "feed_pos"), [*keys, "feed_pos"], "left_semi")


def first_wins(batch: DataFrame) -> DataFrame:
    """One entry per (feed, guid): the oldest, the later one in the body on ties, as rows go in oldest first.

    The rank filter becomes a window group limit, so each map task sends at most one row of a much-copied guid.
    """
    window = Window.partitionBy("feed_id", "guid").orderBy(*_order(_OLDEST))
    return batch.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def insert_ignore(batch: DataFrame, held: DataFrame) -> DataFrame:
    """Rows whose (feed, guid) is not stored. Stored rows are never replaced, so read state survives."""
    return batch.join(held.select("feed_id", "guid"), ["feed_id", "guid"], "left_anti")


def new_items(batch: DataFrame, held: DataFrame, verdicts: DataFrame, poll_keys: list[str],
              cap: int = RETAIN_PER_FEED, bounded: bool = False) -> DataFrame:
    kept = newest_per_poll(without_shorts(batch, verdicts), poll_keys, cap, bounded)
    return insert_ignore(first_wins(kept), held)


def with_ids(fresh: DataFrame, stored_items: DataFrame, last: Column | None = None) -> DataFrame:
    """Give new rows ids that grow with recency, from behind ``last`` (the greatest stored id where that is not given) without a gap.

    Feed ids of any size take part in the order only. Slim keys are sorted in ranges and written; the sizes of the ranges,
    one row each, give every range its offset, and the ids go to the wide rows by key.
    """
    last = F.coalesce(stored_items.agg(F.max("item_id")).scalar() if last is None else last, F.lit(0)).cast("bigint")
    order = [*_order(_OLDEST), F.col("feed_id"), F.col("guid")]
    slim = fresh.select("feed_id", "guid", "published_at", "feed_pos").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(slim.select("feed_id", "guid", F.monotonically_increasing_id().alias("_at")))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
        "feed_id", "guid", (last + F.col("_offset") + inside + 1).alias("item_id"))
    return fresh.join(numbered, ["feed_id", "guid"])
