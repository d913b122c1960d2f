"""Short videos: which ones to ask about, what the answers mean, and the sweep."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.dates import duration_seconds
from feedloom.functions.urls import is_video_feed, video_id
from feedloom.operators.joins import join_checked
from feedloom.operators.ranking import ordinals, top_per_key
from feedloom.schemas import API_BATCH, PROBES_PER_FEED, PROBES_PER_RUN, SHORTS_MAX_SECONDS
from feedloom.session import stored


#: Slices of a feed's work list that are numbered on their own.
SLICES = 64


def stored_videos(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items of video feeds that link to a video."""
    video_feeds = feeds.filter(is_video_feed(F.col("feed_url"))).select("feed_id")
    tagged = items.select("item_id", "feed_id", video_id(F.col("url")).alias("video_id"))
    return tagged.filter("video_id is not null").join(video_feeds, "feed_id", "left_semi")


def unknown_videos(items: DataFrame, feeds: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Stored videos without a verdict, once per feed, at their first stored item."""
    found = stored_videos(items, feeds).join(verdicts.select("video_id"), "video_id", "left_anti")
    return found.groupBy("feed_id", "video_id").agg(F.min("item_id").alias("item_id"))


def unclassified(items: DataFrame, feeds: DataFrame, verdicts: DataFrame) -> DataFrame:
    """How many stored videos still lack a verdict, counted per feed."""
    return unknown_videos(items, feeds, verdicts).agg(F.count(F.lit(1)).alias("unclassified"))


def probe_plan(work: DataFrame, per_feed: int = PROBES_PER_FEED, per_run: int = PROBES_PER_RUN) -> DataFrame:
    """Which videos this run asks about: feed by feed in stored order, within both budgets."""
    capped = top_per_key(work.select("feed_id", "video_id", "item_id"), ["feed_id"], [F.col("item_id")], per_feed,
                         ["item_id"])
    return capped.orderBy("feed_id", "rank").limit(per_run).select("feed_id", "video_id", "rank")


def api_batches(work: DataFrame, size: int = API_BATCH) -> DataFrame:
    """The work list in numbered batches for an external duration lookup, ids joined by commas.

    Rows are numbered inside slices of their feed. The slices' bounds are the feed's approximate percentiles, so they are
    even whatever the ids look like.
    """
    cuts = stored(work.groupBy("feed_id").agg(
        F.percentile_approx("item_id", [k / SLICES for k in range(1, SLICES)], 1000).alias("_cuts")))
    sliced = work.join(cuts, "feed_id").withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("item_id")))).drop("_cuts")
    placed = ordinals(sliced, ["feed_id"], F.col("_slice"), [F.col("item_id")])
    batch = F.floor((F.col("ordinal") - 1) / size)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "video_id"))), lambda r: r["video_id"])
    return placed.groupBy("feed_id", batch.alias("batch")).agg(F.array_join(ids, ",").alias("ids"),
                                                               F.count(F.lit(1)).alias("n"))


def short_enough(seconds: Column) -> Column:
    return F.coalesce((seconds > 0) & (seconds <= SHORTS_MAX_SECONDS), F.lit(False))


def candidates(answers: DataFrame) -> DataFrame:
    """Videos short enough to be a Short, from landed durations (``duration`` text or ``seconds``)."""
    seconds = F.col("seconds") if "seconds" in answers.columns else duration_seconds(F.col("duration"))
    return answers.filter(short_enough(seconds))


def surface_verdict(status: Column, location: Column) -> Column:
    """1 for a page that stays on the Shorts surface, 0 for one sent to the watch page, null for no answer."""
    sent_on = status.between(300, 399) & F.coalesce(location, F.lit("")).contains("/watch")
    return F.when(sent_on, 0).when(status == 200, 1)


def classify(answers: DataFrame, keyed: bool = True) -> DataFrame:
    """Verdicts for the videos that got one.

    ``answers`` holds one row per asked video: ``seconds`` (null where the duration service omitted it), ``http_status``
    and ``location`` of the surface probe. With ``answered`` false the duration batch failed and nothing is settled.
    Without a key the surface alone decides. Of several answers for one video the latest by ``checked_at`` counts; where
    that column is missing, a video that one answer calls a Short is one.
    """
    surface = surface_verdict(F.col("http_status"), F.col("location"))
    verdict = F.when(short_enough(F.col("seconds")), surface).otherwise(0) if keyed else surface
    if keyed and "answered" in answers.columns:
        verdict = F.when(F.col("answered"), verdict)
    settled = answers.withColumn("is_short", verdict.cast("int")).filter("is_short is not null")
    if "checked_at" not in answers.columns:
        return settled.groupBy("video_id").agg(F.max("is_short").alias("is_short"))
    return settled.groupBy("video_id").agg(F.max_by("is_short", F.struct("checked_at", "is_short")).alias("is_short"),
                                           F.max("checked_at").alias("checked_at"))


def upsert_verdicts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored verdicts with the fresh ones on top, one row per video. ``fresh`` has one row per video, as ``classify``
    gives it; columns that it lacks are null."""
    fresh = fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c)
                           for c in stored.columns])
    return stored.join(fresh.select("video_id"), "video_id", "left_anti").unionByName(fresh.select(*stored.columns))


def doomed(items: DataFrame, feeds: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Ids of stored items that are known Shorts."""
    shorts = verdicts.filter("is_short = 1").select("video_id")
    return stored_videos(items, feeds).join(shorts, "video_id", "left_semi").select("item_id")


def sweep(items: DataFrame, feeds: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items without the known Shorts of video feeds. Verdicts outlive the items they remove."""
    return join_checked(items, doomed(items, feeds, verdicts), "item_id", "left_anti")
