"""The reading list: views, feed and folder filters, order, pages, single items, cards."""
from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import dates, text, urls
from feedloom.schemas import PAGE_SIZE

View = Literal["unread", "all", "starred"]


def sort_time() -> Column:
    return F.coalesce(F.col("published_at"), F.col("fetched_at"))


def newest_first() -> list[Column]:
    return [sort_time().desc(), F.col("item_id").desc()]


def in_scope(items: DataFrame, feeds: DataFrame, feed_id: int | None = None, folder: str | None = None) -> DataFrame:
    """A feed filter wins over a folder filter; a folder is matched by its exact spelling."""
    if feed_id is not None:
        return items.filter(F.col("feed_id") == feed_id)
    if folder is not None:
        return items.join(feeds.filter(F.col("folder") == folder).select("feed_id"), "feed_id", "left_semi")
    return items


def in_view(items: DataFrame, view: View) -> DataFrame:
    if view == "unread":
        return items.filter(F.col("is_read") == 0)
    if view == "starred":
        return items.filter(F.col("is_starred") == 1)
    if view != "all":
        raise ValueError(f"no such view: {view}")
    return items


def with_feed(items: DataFrame, feeds: DataFrame, *more: str) -> DataFrame:
    """The thirteen item columns, two of them the feed's, and any further ones asked for."""
    names = feeds.select("feed_id", F.col("title").alias("feed_title"), F.col("site_url").alias("feed_site"))
    return items.join(names, "feed_id").select(
        "item_id", "feed_id", "url", "title", "author", "summary", "content", "published_at", "fetched_at",
        "is_read", "is_starred", "feed_title", "feed_site", *more)


def list_items(items: DataFrame, feeds: DataFrame, view: View = "unread", feed_id: int | None = None,
               folder: str | None = None, page: int = 0, after: tuple | None = None,
               page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of the list. Building it starts no job.

    The page is chosen from the key columns alone; its ids (at most ``page_size``) then go back to the table when the
    query runs, their bounds as a filter that reaches the scan, so article bodies are read for the page and not for the
    table. ``after=(sort_time, item_id)`` asks for the rows behind a known row, which stays cheap where a deep offset
    does not.
    """
    keys = in_scope(in_view(items, view), feeds, feed_id, folder).select("item_id", "published_at", "fetched_at")
    if after is not None:
        ts, item_id = F.lit(after[0]).cast("timestamp"), after[1]
        keys = keys.filter((sort_time() < ts) | ((sort_time() == ts) & (F.col("item_id") < item_id)))
    ids = keys.orderBy(*newest_first()).offset(page * page_size).limit(page_size).select("item_id")
    # As rows, not as aggregates: Spark would merge two of these into one pair, which does not reach the scan.
    least, greatest = (ids.orderBy(by).limit(1).scalar() for by in (F.col("item_id").asc(), F.col("item_id").desc()))
    span = items.filter((F.col("item_id") >= least) & (F.col("item_id") <= greatest))
    # A page's ids are bounded by its size.
    chosen = span.join(F.broadcast(ids), "item_id", "left_semi")
    return with_feed(chosen, feeds).orderBy(*newest_first()).limit(page_size)


def count_items(items: DataFrame, feeds: DataFrame, view: View = "unread", feed_id: int | None = None,
                folder: str | None = None) -> DataFrame:
    return in_scope(in_view(items, view), feeds, feed_id, folder).agg(F.count(F.lit(1)).alias("n"))


def page_state(n: Column, page: int, page_size: int = PAGE_SIZE) -> list[Column]:
    """Whether there is a page before and after this one, given the total."""
    return [F.lit(page > 0).alias("has_prev"), (n > (page + 1) * page_size).alias("has_next")]


def items_by_id(items: DataFrame, feeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items asked for by id; an id that holds no item gives no row."""
    return with_feed(items.join(wanted.select("item_id").distinct(), "item_id", "left_semi"), feeds)


def _shown(now: Column) -> dict[str, Column]:
    """What a list row and a reading view both show."""
    video = urls.video_id(F.col("url"))
    title, author = text.strip_tags(F.col("title")), text.strip_tags(F.col("author"))
    return {
        "title": F.when(title == "", "(untitled)").otherwise(title),
        "author": F.when((F.col("author") != "") & (author != F.coalesce(F.col("feed_title"), F.lit(""))), author),
        "source": F.coalesce(text.blank_to_null(F.col("feed_title")), F.lit("feed")),
        "link": F.when(video.isNotNull(), F.concat(F.lit("/rss/watch?v="), video)).otherwise(urls.safe_url(F.col("url"))),
        "is_video": video.isNotNull(),
        "age": dates.relative_date(sort_time(), now),
    }


def item_cards(listed: DataFrame, now: Column) -> DataFrame:
    """What a list row shows: plain title, author unless it repeats the feed, excerpt, link, video flag, age."""
    body = F.coalesce(text.blank_to_null(F.col("summary")), text.blank_to_null(F.col("content")))
    shown = [c.alias(n) for n, c in _shown(now).items()]
    return listed.select("item_id", "feed_id", *shown, text.excerpt(body).alias("excerpt"), "is_read", "is_starred")


def item_views(listed: DataFrame, now: Column) -> DataFrame:
    """What a reading view shows: the card's fields, the feed's site, the body's paragraphs and its safe links."""
    body = F.coalesce(text.blank_to_null(F.col("content")), text.blank_to_null(F.col("summary")), F.lit(""))
    shown = [c.alias(n) for n, c in _shown(now).items()]
    return listed.withColumn("_body", body).select(
        "item_id", "feed_id", *shown, urls.safe_url(F.col("feed_site")).alias("site"),
        text.reading_paragraphs(F.col("_body")).alias("paragraphs"), text.reading_links(F.col("_body")).alias("links"))
