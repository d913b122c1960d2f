"""Counts per feed, per folder and in total; feed health panels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import text, urls
from feedloom.schemas import PANEL_MAX, UNGROUPED


def folder_name(folder: str = "folder") -> Column:
    return F.trim(F.coalesce(F.col(folder), F.lit("")))


def feed_label() -> Column:
    return F.coalesce(text.blank_to_null(F.col("title")), F.col("feed_url"))


def badge(n: Column) -> Column:
    return F.when(n > 999, "999+").when(n == 0, "").otherwise(n.cast("string"))


def unread_by_feed(items: DataFrame) -> DataFrame:
    return items.filter(F.col("is_read") == 0).groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"))


def held_by_feed(items: DataFrame) -> DataFrame:
    return items.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"))


def unread_total(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(F.col("is_read") == 0).alias("unread"))


def is_erroring() -> Column:
    return F.coalesce(F.col("last_status") == "error", F.lit(False))


def is_silent() -> Column:
    """Polled, not erroring, holding nothing. A feed never polled is new, not silent."""
    return F.coalesce((F.col("last_status") != "error") & (F.col("last_status") != ""), F.lit(False)) & (F.col("held") == 0)


def manage_rows(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """Every feed with its counts and state. One pass over the items gives both counts."""
    counts = items.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("held"), F.count_if(F.col("is_read") == 0).alias("unread"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = feeds.join(counts, "feed_id", "left").select(feeds["*"], zero("held"), zero("unread"))
    status = F.when(is_erroring(), "error").when(F.coalesce(F.col("last_status"), F.lit("")) != "", "ok").otherwise("new")
    why = F.coalesce(text.strip_tags(text.blank_to_null(F.col("last_error"))), F.lit("no detail recorded"))
    return joined.select(
        "feed_id", "feed_url", feed_label().alias("label"), folder_name().alias("folder"), "last_status",
        urls.safe_url(F.col("site_url")).alias("site"), "held", "unread", status.alias("status"),
        is_erroring().alias("erroring"), is_silent().alias("silent"),
        F.when(is_erroring(), why).alias("error_text"))


def silent_feeds(feeds: DataFrame, items: DataFrame) -> DataFrame:
    return manage_rows(feeds, items).filter("silent").select("feed_id", "feed_url", "label", "last_status")


def erroring_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter(is_erroring()).select("feed_id", "feed_url", feed_label().alias("label"), "last_error")


def sidebar(feeds: DataFrame, items: DataFrame) -> DataFrame:
    rows = manage_rows(feeds, items)
    dot = F.when(F.col("erroring"), "err").when(F.col("status") == "new", "new").otherwise("")
    return rows.select("feed_id", "folder", "label", "unread", badge(F.col("unread")).alias("badge"), dot.alias("dot"))


def sidebar_rollup(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """Unread per feed, folder and in total. ``level``: 0 feed, 1 folder, 3 everything."""
    rows = feeds.select("feed_id", folder_name().alias("folder")).join(unread_by_feed(items), "feed_id", "left")
    return rows.rollup("folder", "feed_id").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("feeds"), F.coalesce(F.sum("n"), F.lit(0)).alias("unread"),
    ).withColumn("badge", badge(F.col("unread")))


def folder_summary(feeds: DataFrame, items: DataFrame) -> DataFrame:
    return manage_rows(feeds, items).groupBy("folder").agg(
        F.count(F.lit(1)).alias("feeds"), F.sum("unread").alias("unread"),
        F.count_if("erroring").alias("erroring"), F.count_if("silent").alias("silent"))


def manage_tally(feeds: DataFrame, items: DataFrame) -> DataFrame:
    return manage_rows(feeds, items).agg(
        F.count(F.lit(1)).alias("feeds"), F.count_distinct(text.blank_to_null(F.col("folder"))).alias("folders"),
        F.count_if("erroring").alias("erroring"), F.count_if("silent").alias("silent"))


def folders(feeds: DataFrame) -> DataFrame:
    return feeds.select(folder_name().alias("folder")).filter("folder <> ''").distinct()


def folder_options(feeds: DataFrame, current: DataFrame) -> DataFrame:
    """The folders to choose from, with the current ones added where the list lacks them."""
    return folders(feeds).union(folders(current)).distinct()


def feeds_by_folder(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """Every feed under its section, one row per feed, in page order: folders by name, ungrouped last."""
    rows = manage_rows(feeds, items)
    section = F.when(F.col("folder") == "", UNGROUPED).otherwise(F.col("folder"))
    return (rows.select(section.alias("section"), "feed_id", "label", "feed_url", "status", "held", "unread")
            .orderBy(F.col("section") == UNGROUPED, F.collate("section", "UNICODE"), F.lower("label"), "feed_url"))


def error_panel(feeds: DataFrame, limit: int = PANEL_MAX) -> DataFrame:
    """The first erroring feeds by title, each row carrying how many more there are."""
    bad = erroring_feeds(feeds)
    total = bad.agg(F.count(F.lit(1))).scalar()
    shown = feeds.filter(is_erroring()).orderBy(F.lower("title"), "feed_url").limit(limit)
    return shown.select("feed_id", feed_label().alias("label"), "feed_url",
                        F.coalesce(text.strip_tags(text.blank_to_null(F.col("last_error"))),
                                   F.lit("no detail recorded")).alias("why"),
                        F.greatest(total - limit, F.lit(0).cast("bigint")).alias("more"))
