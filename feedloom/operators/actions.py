"""Reader actions as a log: read, star, mark-all, open; feed edits, deletes and subscriptions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions.text import blank_to_null, utf16_left
from feedloom.operators.joins import join_checked
from feedloom.schemas import FEED_TITLE_CAP, FOLDER_CAP
from feedloom.session import stored


SLICE_SECONDS, SLICE_ROWS = 3_600, 100_000


def _next_mark(waiting: DataFrame, marks: DataFrame, keys: list[str], slice_seconds: int = SLICE_SECONDS,
               slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For every (item_id, since) the first mark after ``since`` under the same keys. Both are (time, action id) pairs.

    Time is cut into slices. An item finds its mark in its own slice, or takes the first mark of the later ones, which one
    row per (keys, slice) tells. Marks therefore go to slices that hold waiting items only, once each; a slice of more than
    ``slice_rows`` items is cut further by item, and only its own marks are copied to its cuts.
    """
    no_time = F.lit(-(1 << 62))
    cut = lambda at: F.coalesce(F.floor(F.unix_seconds(at["ts"]) / slice_seconds), no_time).alias("slice")
    at = [*keys, "slice"]
    items = waiting.select(*keys, "item_id", "since", cut(F.col("since")))
    given = marks.select(*keys, "seq", cut(F.col("seq")))
    held = items.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("cuts"))
    firsts = given.groupBy(*at).agg(F.min("seq").alias("first"))
    behind = Window.partitionBy(*keys).orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slices = held.join(firsts, at, "full").withColumn("later", F.min("first").over(behind)).filter(
        "cuts is not null and (first is not null or later is not null)")
    # Written once: items and marks both meet these rows, which are few.
    slices = stored(slices.select(*at, "cuts", "later", F.col("first").isNotNull().alias("marked")))
    sited = items.join(slices, at)
    waits = sited.filter("marked").select(*at, F.pmod(F.xxhash64("item_id"), "cuts").alias("cut"), "item_id", "later",
                                          F.col("since").alias("at"), F.lit(None).cast(given.schema["seq"].dataType).alias("mark"))
    copies = given.join(slices.filter("marked").drop("later", "marked"), at).select(
        *at, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("cut"),
        F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
        F.lit(None).cast(given.schema["seq"].dataType).alias("later"), F.col("seq").alias("at"), F.col("seq").alias("mark"))
    latest_first = Window.partitionBy(*at, "cut").orderBy(F.col("at").desc(), F.col("mark").desc_nulls_last())
    seen = F.last("mark", ignorenulls=True).over(latest_first.rowsBetween(Window.unboundedPreceding, 0))
    # Dealt by the cut as well, or the join's dealing by slice would stand and a hot slice stay whole.
    found = waits.unionByName(copies).repartition(*at, "cut").withColumn("next", F.coalesce(seen, "later"))
    return found.filter("item_id is not null").select("item_id", "next").unionByName(
        sited.filter("not marked").select("item_id", F.col("later").alias("next"))).filter("next is not null")


def mark_all_scopes(actions: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark-all actions as (per feed, over everything). A feed scope beats a folder scope."""
    marks = actions.filter("act = 'mark-all'")
    folder = F.coalesce(F.trim("folder"), F.lit("")) if "folder" in actions.columns else F.lit("")
    seq = F.struct("ts", F.col("action_id").cast("bigint").alias("action_id")).alias("seq")
    by_feed = marks.filter("feed_id is not null").select("feed_id", seq)
    rest = marks.filter("feed_id is null").select(seq, folder.alias("folder"))
    by_folder = rest.filter("folder <> ''").join(feeds.select("feed_id", "folder"), "folder").select("feed_id", "seq")
    return by_feed.unionByName(by_folder).distinct(), rest.filter("folder = ''").select("seq").distinct()


def apply_actions(items: DataFrame, actions: DataFrame, feeds: DataFrame, arrived: Column | None = None) -> DataFrame:
    """Read and star state after the log: ``item_id, is_read, is_starred, read_at`` for every item.

    Later actions win. Marking an item read stamps it each time; opening it or marking all read stamps it only while it
    is unread; marking it unread clears the stamp. ``arrived`` says from when a mark-all can reach an item.
    """
    arrived = F.col("fetched_at") if arrived is None else arrived
    own = actions.filter("act <> 'mark-all'").select("item_id", "act", "state", F.struct("ts", F.col("action_id").cast("bigint").alias("action_id")).alias("at"))
    is_read_act = F.col("act").isin("open", "mark-read")
    unread = (F.col("act") == "mark-read") & (F.col("state") == 0)
    star = F.col("act") == "star"
    # Partial aggregates keep an item with a third of the log from reaching one task whole.
    last = own.groupBy("item_id").agg(F.max(F.when(unread, F.col("at"))).alias("unread_at"),
                                      F.max_by(F.when(star, F.col("state")), F.when(star, F.col("at"))).alias("star"))
    after = F.col("unread_at").isNull() | (F.col("at") > F.col("unread_at"))
    reads = own.filter(is_read_act & ~unread).join(last, "item_id").filter(after).groupBy("item_id").agg(
        F.min("at").alias("first_read"),
        F.max(F.when(F.col("act") == "mark-read", F.col("at"))).alias("stamp"))
    changes = last.join(reads, "item_id", "left")

    slim = items.select("item_id", "feed_id", "is_read", "is_starred", "read_at", arrived.alias("arrived"))
    state = join_checked(slim, changes, "item_id", "left")
    # A mark reaches an item from the second it arrived, and an unread item only by a later action.
    reached = F.struct(F.col("arrived").alias("ts"), F.lit(-(1 << 63)).alias("action_id"))
    since = F.when(F.col("unread_at").isNull() | (reached > F.col("unread_at")), reached).otherwise(F.col("unread_at"))
    waiting = state.filter(((F.col("is_read") == 0) | F.col("unread_at").isNotNull()) & F.col("stamp").isNull()).select(
        "item_id", "feed_id", since.alias("since"))
    by_feed, by_all = mark_all_scopes(actions, feeds)
    marked = _next_mark(waiting, by_feed, ["feed_id"]).unionByName(_next_mark(waiting, by_all, [])).groupBy("item_id").agg(F.min("next.ts").alias("marked_at"))

    first = F.least(F.col("first_read.ts"), F.col("marked_at"))
    stays = (F.col("is_read") == 1) & F.col("unread_at").isNull()
    read = stays | F.col("stamp").isNotNull() | first.isNotNull()
    stamp = F.coalesce(F.col("stamp.ts"), F.when(stays, F.col("read_at")).otherwise(first))
    return state.join(marked, "item_id", "left").select(
        "item_id", F.when(read, 1).otherwise(0).alias("is_read"),
        F.coalesce("star", "is_starred").cast("int").alias("is_starred"), F.when(read, stamp).alias("read_at"))


def merge_state(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with new read and star state. Only changed rows take part, so wide rows stay put while changes are few."""
    parts = ("is_read", "is_starred", "read_at")
    new = state.select("item_id", F.struct(*parts).alias("_new"))
    old = items.select("item_id", F.struct(*parts).alias("_old"))
    changed = old.join(new, "item_id").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("item_id", "_new")
    merged = join_checked(items, changed, "item_id", "left")
    return merged.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
                           if c in parts else F.col(c) for c in items.columns])


def apply_feed_edits(feeds: DataFrame, edits: DataFrame) -> DataFrame:
    """Titles and folders after the log: ``update-feed`` sets both, ``set-folder`` the folder alone."""
    renames = F.col("act") == "update-feed"
    title = F.struct(utf16_left(F.trim(F.coalesce("title", F.lit(""))), FEED_TITLE_CAP).alias("value"))
    folder = F.struct(blank_to_null(utf16_left(F.trim("folder"), FOLDER_CAP)).alias("value"))
    last = edits.groupBy("feed_id").agg(
        F.max_by(F.when(renames, title), F.when(renames, F.col("action_id"))).alias("_title"),
        F.max_by(folder, F.col("action_id")).alias("_folder"))
    set_by = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).otherwise(F.col(c)).alias(c)
    merged = feeds.join(last, "feed_id", "left")
    return merged.select(*[set_by(c) if c in ("title", "folder") else F.col(c) for c in feeds.columns])


def delete_feeds(feeds: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feeds and items without the deleted feeds."""
    ids = gone.select("feed_id").distinct()
    return feeds.join(ids, "feed_id", "left_anti"), join_checked(items, ids, "feed_id", "left_anti")


def canonical_folders(requests: DataFrame, feeds: DataFrame) -> DataFrame:
    """The folder each request asks for. A newly typed name beats the chosen one, and where it differs from an existing
    folder only in case or accent it is that folder, in its stored spelling."""
    key = lambda c: F.collate(c, "UNICODE_CI_AI")
    typed, chosen = F.trim(F.coalesce("folder_new", F.lit(""))), F.trim(F.coalesce("folder", F.lit("")))
    stored = feeds.select(F.trim("folder").alias("name")).filter("name <> ''").groupBy(
        key(F.col("name")).alias("_key")).agg(F.min(F.collate("name", "UTF8_BINARY")).alias("_stored"))
    want = utf16_left(F.when(typed != "", typed).otherwise(chosen), FOLDER_CAP)
    asked = requests.withColumn("_want", want).withColumn("_key", key(F.when(typed != "", want)))
    named, plain = asked.filter("_key is not null"), asked.filter("_key is null").withColumn("_stored", F.lit(None).cast("string"))
    found = named.join(stored, "_key", "left").unionByName(plain)
    keep = [c for c in requests.columns if c not in ("folder", "folder_new")]
    return found.select(*keep, blank_to_null(F.coalesce("_stored", "_want")).alias("folder"))


def already_message(title: Column, folder: Column, feed_url: Column) -> Column:
    where = F.trim(F.coalesce(folder, F.lit("")))
    label = F.coalesce(blank_to_null(utf16_left(F.coalesce(title, F.lit("")), FEED_TITLE_CAP)), feed_url)
    place = F.when(where != "", F.concat(F.lit(" (in "), where, F.lit(")"))).otherwise(" (ungrouped)")
    return F.concat(F.lit("Already subscribed: "), label, place, F.lit(". Change its folder from Manage feeds."))


def add_feeds(requests: DataFrame, feeds: DataFrame) -> DataFrame:
    """What becomes of each request: ``added`` for the first one of a new address, else ``already`` with a message that
    names the feed that is there. Rows with ``added`` are the feeds to insert."""
    title = utf16_left(F.coalesce("title", F.lit("")), FEED_TITLE_CAP)
    asked = requests.withColumn("title", title).withColumn("folder", blank_to_null(F.trim("folder")))
    winners = asked.groupBy("feed_url").agg(F.min_by(F.struct("request_id", "title", "folder"), "request_id").alias("w"))
    known = feeds.select("feed_url", F.struct("title", "folder").alias("k"))
    there = winners.join(known, "feed_url", "left").select(
        "feed_url", F.when(F.col("k").isNull(), F.col("w.request_id")).alias("first_id"),
        F.when(F.col("k").isNull(), F.col("w.title")).otherwise(F.col("k.title")).alias("there_title"),
        F.when(F.col("k").isNull(), F.col("w.folder")).otherwise(F.col("k.folder")).alias("there_folder"))
    is_new = F.coalesce(F.col("request_id") == F.col("first_id"), F.lit(False))
    added = F.concat(F.coalesce(blank_to_null(F.col("title")), F.col("feed_url")),
                     F.when(F.col("folder").isNotNull(), F.concat(F.lit(" → "), "folder")).otherwise(""))
    return asked.join(there, "feed_url").select(
        "request_id", "feed_url", "site_url", "title", "folder", F.when(is_new, "added").otherwise("already").alias("result"),
        F.when(is_new, added).otherwise(already_message(F.col("there_title"), F.col("there_folder"), F.col("feed_url")))
        .alias("message"))
