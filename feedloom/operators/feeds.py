"""The feed table: scans and the selection of feeds due for a poll."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.schemas import BACKOFF_MINUTES, ERROR_BACKOFF_THRESHOLD


def scan_feeds(feeds: DataFrame) -> DataFrame:
    cols = ["feed_id", "title", "feed_url", "site_url", "folder", "last_status", "last_error"]
    return feeds.select(*cols).orderBy(F.lower("title"), "feed_url")


def due_feeds(feeds: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Feeds to poll, never-polled ones first, then the longest unpolled; ``force`` takes every feed."""
    waited = F.col("last_polled_at") < now - F.expr(f"INTERVAL {BACKOFF_MINUTES} MINUTES")
    due = (F.col("error_count") < ERROR_BACKOFF_THRESHOLD) | F.col("last_polled_at").isNull() | waited
    chosen = feeds if force else feeds.filter(due)
    return (chosen.select("feed_id", "feed_url", "error_count", "last_polled_at")
            .orderBy(F.col("last_polled_at").asc_nulls_first(), "feed_id"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("run_id").desc()).limit(1).select("run_id", "started_at", "finished_at")


def status_json(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Newest run and unread total as one JSON record; both are scalar subqueries, so nothing is cross joined."""
    newest = runs.agg(F.max(F.struct("run_id", "started_at", "finished_at"))).scalar()
    unread = items.agg(F.count_if(F.col("is_read") == 0)).scalar()
    one = runs.sparkSession.range(1).select(newest.alias("run"), unread.alias("unread"))
    return one.select(F.to_json(F.struct(
        F.col("run.run_id").alias("poll"),
        F.date_format("run.started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.date_format("run.finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"),
        F.col("unread")), {"ignoreNullFields": "false"}).alias("status"))
