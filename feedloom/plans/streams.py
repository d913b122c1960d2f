"""Queries of the whole poll and of the streaming forms."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from feedloom.operators.html import READER_LIMITS
from feedloom.operators.poll import Poll, poll_cycle
from feedloom.plans.bindings import POLLS, Tables
from feedloom.plans.documents import mixed
from feedloom.plans.polling import _NOT_SHORT
from feedloom.plans.reading import now
from feedloom.plans.registry import query
from feedloom.schemas import FEEDS, ITEMS
from feedloom.session import shared_dir, stored
from feedloom.sources.landed import read_fetches, stream_fetches
from feedloom.sources.tables import Table
from feedloom.streaming import health, ingest
from feedloom.streaming.poll import PollTables, start_polls

_RULE = '{"item":"li","link":"a"}'
# A poll has one response per feed, so each body of a source stands for a feed of its own; pages are scrape feeds.
_BODY_FEED = 1_000_000


def fetches(t: Tables) -> DataFrame:
    number = F.col("feed_id") * _BODY_FEED + F.element_at(F.split("fetch_id", "-"), -1).cast("bigint")
    plain = mixed(t).select(
        "fetch_id", number.alias("feed_id"), F.when(F.col("feed_id") % 10 == 1, F.concat(
            F.lit("https://www.youtube.com/feeds/videos.xml?channel_id=UC"), "fetch_id"))
        .otherwise(F.concat(F.lit("https://feeds.example/"), "fetch_id")).alias("url"),
        F.lit("feed").alias("kind"), "content_type", F.encode("body", "UTF-8").alias("body"))
    pages = t.pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("fetch_id"), (-F.col("page_id") - 1).alias("feed_id"),
        "url", F.lit("scrape").alias("kind"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.encode("html", "UTF-8").alias("body"))
    null = F.lit(None).cast("string")
    return plain.unionByName(pages).select(
        "fetch_id", "feed_id", "url", F.col("url").alias("final_url"), "kind",
        F.when(F.col("kind") == "scrape", _RULE).alias("scrape_rule"), F.lit(200).alias("status"),
        null.alias("network_error"), "content_type", F.octet_length("body").cast("bigint").alias("content_length"),
        F.lit("W/1").alias("etag"), null.alias("last_modified"), "body", now().alias("fetched_at"))


def known_feeds(t: Tables, landed: DataFrame) -> DataFrame:
    """A feed for every response, never polled yet."""
    known = landed.select("feed_id", F.col("url").alias("feed_url"), "kind", "scrape_rule")
    given = {"title": F.lit(""), "error_count": F.lit(0)}
    columns = [(p.split()[0], p.split()[1]) for p in FEEDS.split(", ")]
    return known.select(*[F.col(n) if n in known.columns else given.get(n, F.lit(None)).cast(k).alias(n)
                          for n, k in columns])


def polled(t: Tables) -> Poll:
    # Landed once: the feeds are read from the responses' slim columns.
    landed = stored(fetches(t))
    none = t.spark.createDataFrame([], ITEMS)
    return poll_cycle(landed, known_feeds(t, landed), none, t.verdicts, t.probes, now(), **READER_LIMITS)


_BODY_SQL = f"feed_id*{_BODY_FEED} + item_id//200"
query("poll_cycle", f"""select {_BODY_SQL} as feed_id, count(distinct guid) as held from items_v i where {_NOT_SHORT} group by 1
union all select -page_id-1, len(list_distinct(regexp_extract_all(html,'<li><a href="([^"]*)">',1))) as held from pages
where contains(html,'<li><a ')""", "items verdicts")(
    lambda t: polled(t).items.groupBy("feed_id").agg(F.count(F.lit(1)).alias("held")))
query("poll_feeds", f"""select {_BODY_SQL} as feed_id, 'ok' as last_status, 'Feed '||feed_id as title, 0 as error_count
from items_v group by feed_id, 1 union all select -page_id-1, case when contains(html,'<li><a ') then 'ok' else 'error' end,
 case when contains(html,'<li><a ') then coalesce(nullif(trim(regexp_replace(replace(regexp_extract(html,'<title>(.*?)</title>',1),
 '&amp;','&'),'\\s+',' ','g')),''),'') else '' end, case when contains(html,'<li><a ') then 0 else 1 end from pages""", "items")(
    lambda t: polled(t).feeds.select("feed_id", "last_status", "title", "error_count"))


def _folder(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/feedloom/{uuid.uuid4().hex}"


def _land(t: Tables, path: str, parts: int) -> int:
    """Write the responses by feed, in ``parts`` times as many files as there are cores, and say how many stand for one part."""
    cores = t.spark.sparkContext.defaultParallelism
    fetches(t).repartition(parts * cores, "feed_id").write.parquet(path)
    return cores


def _drained(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its output back."""
    base, schema = _folder(t), stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/{batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schema.add("batch_id", IntegerType())).parquet(f"{base}/out/*")


def _stream(t: Tables, name: str) -> DataFrame:
    """A driver table as a file stream."""
    return t.spark.readStream.schema(t.read(name).schema).parquet(f"{t.dir}/{name}.parque[t]")


def poll_stream(t: Tables) -> DataFrame:
    """The polls as a stream, pages of every third feed scraped, with a validator on each answer."""
    return t.spark.sql(POLLS, events=_stream(t, "events")).withColumns({
        "scraped": F.col("feed_id") % 3 == 2, "etag": F.concat(F.lit('W/"'), F.col("poll_id").cast("string"), F.lit('"'))})


@query("stream_ingest", f"""select distinct {_BODY_SQL} as feed_id, guid from items_v i where {_NOT_SHORT}
union all select -page_id-1, regexp_extract(url,'^(https?://[^/?#]+)',1)||'/'||replace(url_encode(word),'%2C',',') from (
 select page_id, url, unnest(list_distinct(regexp_extract_all(html,'<li><a href="/([^"]*)">',1))) as word from pages)""",
       "items verdicts")
def _stream_ingest(t: Tables) -> DataFrame:
    base = _folder(t)
    part = _land(t, f"{base}/landed", 4)
    items = Table(t.spark, f"{base}/items", ITEMS, bucket_by="feed_id")
    polls = Table(t.spark, f"{base}/polls", ingest.POLL_LOG)
    ingest.start_ingest(stream_fetches(t.spark, f"{base}/landed", 2 * part), items, t.verdicts, polls,
                        f"{base}/checkpoint", limits=READER_LIMITS).awaitTermination()
    return items.read().select("feed_id", "guid")


@query("stream_poll", f"""with held as (select {_BODY_SQL} as feed_id, count(distinct guid) as held from items_v i where {_NOT_SHORT} group by 1
 union all select -page_id-1, len(list_distinct(regexp_extract_all(html,'<li><a href="([^"]*)">',1))) from pages where contains(html,'<li><a ')),
known as (select {_BODY_SQL} as feed_id, 'ok' as last_status, 0 as error_count from items_v group by feed_id, 1
 union all select -page_id-1, case when contains(html,'<li><a ') then 'ok' else 'error' end, case when contains(html,'<li><a ') then 0 else 1 end from pages)
select feed_id, last_status, error_count, coalesce(held, 0) as held from known left join held using (feed_id)""", "items verdicts")
def _stream_poll(t: Tables) -> DataFrame:
    """The poll in micro-batches, state, sweep, retention and run log included."""
    base = _folder(t)
    part = _land(t, f"{base}/landed", 3)
    landed = read_fetches(t.spark, f"{base}/landed")
    tables = PollTables.at(t.spark, f"{base}/tables")
    tables.begin(known_feeds(t, landed), verdicts=t.verdicts.withColumn("checked_at", F.lit(None).cast("timestamp")))
    start_polls(stream_fetches(t.spark, f"{base}/landed", part), tables, t.probes, f"{base}/checkpoint", READER_LIMITS).awaitTermination()
    feeds, items, _ = tables.read()
    counts = items.groupBy("feed_id").agg(F.count(F.lit(1)).alias("held"))
    return feeds.join(counts, "feed_id", "left").select("feed_id", "last_status", "error_count", F.coalesce("held", F.lit(0)).alias("held"))


@query("stream_dedup", "select distinct feed_id, guid from items_v", "items")
def _stream_dedup(t: Tables) -> DataFrame:
    documents = _stream(t, "documents")
    entries = documents.select((F.substring("source", 4, 9).cast("bigint") + 1).alias("feed_id"), F.md5("text").alias("guid"),
                               F.timestamp_seconds(F.lit(1706659200) + F.col("doc_id") % 60).alias("fetched_at"))
    return _drained(t, ingest.drop_redelivered(entries)).select("feed_id", "guid")


# Every poll applied to its feed's state, in order; what the watermark has not passed yet is left out.
_HEALTH = """recursive o as (select *, row_number() over (partition by feed_id order by polled_at, poll_id) as k from polls_v),
walk as (select feed_id, cast(0 as bigint) as k, cast(null as bigint) as poll_id, cast(null as timestamp) as polled_at, cast(null as varchar) as last_status,
  cast(0 as bigint) as error_count, cast(null as bigint) as last_item_count, cast(null as varchar) as etag from (select distinct feed_id from polls_v)
 union all select feed_id, k, poll_id, polled_at, case when bad then 'error' else status end, case when bad then error_count+1 else 0 end,
  case when status='ok' and not bad and feed_id%3=2 then n_items else before end,
  case when bad then null when status='ok' then 'W/"'||poll_id||'"' else etag end
 from (select o.*, w.error_count, w.last_item_count as before, w.etag, o.status='error' or coalesce(o.status='ok' and o.feed_id%3=2
   and w.last_item_count>=4 and o.n_items<w.last_item_count*0.5, false) as bad from walk w join o on o.feed_id=w.feed_id and o.k=w.k+1)),
passed as (select max(polled_at) - interval 1 hour as mark from polls_v)"""
query("stream_health", f"""with {_HEALTH} select feed_id, poll_id, polled_at, last_status, error_count, last_item_count, etag from walk, passed
where k>0 and polled_at<=mark""", "polls")(
    lambda t: _drained(t, health.feed_health(poll_stream(t))).select(
        "feed_id", "poll_id", "polled_at", "last_status", "error_count", "last_item_count", "etag"))
query("stream_due", f"""with {_HEALTH} select feed_id, polled_at, error_count, polled_at + interval 6 hour as due_at from (
 select *, lead(polled_at) over (partition by feed_id order by k) as again from walk where k>0), passed
where error_count>=5 and (again is null or again>=polled_at + interval 6 hour) and polled_at + interval 6 hour<=mark""", "polls")(
    lambda t: _drained(t, health.feeds_due(poll_stream(t))).select("feed_id", "polled_at", "error_count", "due_at"))
query("stream_windows", """select time_bucket(interval '20 minutes', polled_at) as window_start, count(*) as polls,
 count(*) filter (where status='ok') as ok, count(*) filter (where status='not-modified') as not_modified,
 count(*) filter (where status='error') as errored from polls_v group by 1""", "polls")(
    lambda t: _drained(t, health.poll_windows(poll_stream(t)), "update").groupBy("window_start").agg(
        F.max_by(F.struct("polls", "ok", "not_modified", "errored"), "batch_id").alias("w")).select("window_start", "w.*"))
