"""One poll over many feeds: responses to outcomes and entries, then items, feed state, verdicts and the run record."""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import urls
from feedloom.functions.text import page_title
from feedloom.operators import ingest, outcome, shorts, state
from feedloom.operators.feeds import due_feeds
from feedloom.operators.html import extract_items, html_nodes, with_rule
from feedloom.operators.parse import items_of, parse_feeds
from feedloom.operators.retention import retention
from feedloom.schemas import RETAIN_PER_FEED
from feedloom.session import stored
from feedloom.sources.tables import Table

_OUTCOME = ["fetch_id", "feed_id", "status", "error", "etag", "last_modified", "feed_title", "site_url", "n_items"]
_ENTRY = ["fetch_id", "feed_id", "feed_pos", "guid", "url", "title", "author", "summary", "content", "published_at"]


def _feed_responses(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = fetches.withColumn("body", F.make_valid_utf8(F.col("body").cast("string")))
    read = stored(outcome.classify_feed(_with_body(parse_feeds(texts.withColumn("raw", F.col("body")))),
                                        F.col("parse_error")).drop("body"))
    good = read.filter("status = 'ok'")
    outcomes = read.withColumn("n_items", F.size("entries")).select(*_OUTCOME)
    return outcomes, items_of(good).select(*_ENTRY)


def _with_body(parsed: DataFrame) -> DataFrame:
    return parsed.withColumnRenamed("raw", "body")


def _scrape_responses(fetches: DataFrame, max_bytes: int | None = None, meta_chars: int | None = None, **of_items) -> tuple[DataFrame, DataFrame]:
    size = F.octet_length("body").cast("bigint")
    texts = with_rule(outcome.decode_bodies(fetches.withColumn("content_length", F.coalesce("content_length", size)), meta_chars),
                      "scrape_rule")
    # Numbered once written, so that each response is a page of its own and keeps its number on a retry.
    texts = stored(texts.withColumn("page_id", F.monotonically_increasing_id()))
    landed = F.coalesce("final_url", "url")
    readable = texts.filter(
        F.col("rule").isNotNull() & F.col("status").between(200, 299)
        & outcome.oversize(F.col("content_length"), F.octet_length("body"), max_bytes).isNull()
        & outcome.is_html(F.col("body"), F.coalesce("content_type", F.lit(""))))
    nodes = stored(html_nodes(readable.select("page_id", landed.alias("url"), F.col("body").alias("html")), max_bytes))
    rules = readable.select("page_id", F.lit(0).alias("rule_id"), "rule")
    found = stored(extract_items(nodes, rules, **of_items))
    counts = found.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("n_items"))
    broken = nodes.filter("error is not null").select("page_id", F.col("error").alias("unread"))
    judged = texts.join(counts, "page_id", "left").join(broken, "page_id", "left")
    outcomes = outcome.classify_scrape(judged, F.col("n_items"), F.col("rule.item"), F.col("unread"), max_bytes)
    adopted = outcomes.withColumns({
        "feed_title": page_title(F.col("body"), of_items.get("max_title")), "site_url": urls.origin(landed),
        "n_items": F.coalesce("n_items", F.lit(0))})
    entries = found.join(texts.select("page_id", "feed_id", "fetch_id"), "page_id").select(
        "fetch_id", "feed_id", (F.col("pos") - 1).cast("int").alias("feed_pos"), "guid", "url", "title",
        F.lit(None).cast("string").alias("author"), "summary", F.lit(None).cast("string").alias("content"), "published_at")
    return adopted.select(*_OUTCOME), entries


def read_responses(fetches: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Outcomes (one per response) and entries (of the good ones). ``limits`` for scraped pages are ``max_bytes``, ``meta_chars`` and
    those of ``extract_items``; there are none unless given (``READER_LIMITS``).

    A body that cannot be read is an error outcome; it never ends the job.
    """
    plain = _feed_responses(fetches.filter(F.coalesce("kind", F.lit("feed")) != "scrape"))
    scraped = _scrape_responses(fetches.filter(F.col("kind") == "scrape"), **limits)
    return plain[0].unionByName(scraped[0]), plain[1].unionByName(scraped[1])


@dataclass
class Poll:
    """What one poll leaves: whole new tables, the run's record, the new entries and the videos settled."""
    items: DataFrame
    feeds: DataFrame
    verdicts: DataFrame
    run: DataFrame
    fresh: DataFrame | None = None
    settled: DataFrame | None = None


def poll_cycle(fetches: DataFrame, feeds: DataFrame, items: DataFrame, verdicts: DataFrame, answers: DataFrame,
               now: Column, force: bool = False, cap: int = RETAIN_PER_FEED, last_id: Column | None = None, **limits) -> Poll:
    """Ingest, sweep, retention, record, in that order, over all due feeds at once, one response per feed.

    ``limits`` are those of ``read_responses``. Tables may hold the polled feeds' rows only, if ``last_id`` names the greatest item id of all.
    ``answers`` are landed durations and surface replies for videos asked about since the last poll. The entries and
    new rows are stored before they are used twice, so neither parsing nor ingest is repeated and a lost executor costs
    one stage.
    """
    due = due_feeds(feeds, now, force).select("feed_id")
    outcomes, entries = read_responses(fetches.join(due, "feed_id", "left_semi"), **limits)
    outcomes, entries = stored(outcomes), stored(entries)
    fresh = stored(ingest.new_items(entries, items, verdicts, ["feed_id", "fetch_id"], cap, bounded=True))
    rows = ingest.with_ids(fresh, items, last_id).withColumns({
        "fetched_at": now, "is_read": F.lit(0), "is_starred": F.lit(0), "read_at": F.lit(None).cast("timestamp")})
    grown = items.unionByName(rows.select(*items.columns))

    unknown = shorts.unknown_videos(grown, feeds, verdicts).select("video_id").distinct()
    settled = shorts.classify(answers.join(unknown, "video_id", "left_semi"))
    settled = stored(settled if "checked_at" in settled.columns else settled.withColumn("checked_at", now))
    known = shorts.upsert_verdicts(verdicts, settled)
    gone = stored(shorts.doomed(grown, feeds, known))
    kept = retention(grown.join(gone, "item_id", "left_anti"), cap)

    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    run = state.run_stats(state.judged(feeds, state.latest(outcomes)), count(fresh), count(gone),
                          shorts.unclassified(grown, feeds, known).scalar())
    return Poll(kept, state.next_feed_state(feeds, outcomes, now), known, run, fresh, settled)


def recorded(runs: Table, run_id: int, trigger: str, poll: Callable[[], Poll]) -> Poll:
    """Run a poll and log it. A run that fails is logged too, and its error goes on. A run logged again replaces itself."""
    clock = lambda: F.lit(dt.datetime.now(dt.timezone.utc))
    started = clock()
    try:
        result = poll()
        runs.put(state.run_record(result.run, run_id, trigger, started, clock()), f"run-{run_id}")
    except Exception as error:
        runs.put(state.failed_run(runs.spark, run_id, trigger, started, clock(), str(error)[:500]), f"run-{run_id}")
        raise
    return result
