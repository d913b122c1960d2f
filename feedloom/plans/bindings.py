"""The driver's tables seen as feeds, items, polls, probes and actions.

Each view is one SQL text that Spark and the checking engine both run: Spark with DataFrames for the names in braces,
the other side with plain table names.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from feedloom.operators.joins import spread_small

NOW = "2024-01-31 12:00:00"

# The sources, and a few feeds that hold nothing.
FEEDS = """
select cast(feed_id as bigint) as feed_id,
 case when feed_id%10=1 then concat('https://www.youtube.com/feeds/videos.xml?channel_id=UC', source)
  else concat('https://',source,'.example/feed') end as feed_url,
 case when feed_id%4=0 then null else concat('https://',source,'.example') end as site_url,
 case when feed_id%7=0 then '' else concat('Source ',cast(feed_id as string)) end as title,
 case feed_id%5 when 0 then null when 1 then 'News' when 2 then 'Tech' when 3 then 'Science' else 'news' end as folder,
 case feed_id%6 when 0 then 'error' when 1 then null when 2 then 'not-modified' else 'ok' end as last_status,
 case when feed_id%6=0 then 'HTTP 403' end as last_error,
 case when feed_id%6=0 then feed_id%9 else 0 end as error_count,
 case when feed_id%6=1 then null
  else cast('2024-01-31 00:00:00' as timestamp) - (feed_id*47) * interval '1' minute end as last_polled_at,
 case when feed_id%2=0 then concat('W/"f',cast(feed_id as string),'"') end as etag,
 case when feed_id%3=0 then 'Mon, 01 Jan 2024 00:00:00 GMT' end as last_modified,
 case when feed_id%3=2 then 'scrape' else 'feed' end as kind,
 case when feed_id%3=2 then (feed_id%4)*30+2 end as last_item_count
from (select distinct cast(substring(source,4) as int)+1 as feed_id, source from (select source from {documents}
      union all select concat('src', cast(n_nationkey as string)) from {nation}) s) t
"""

ITEMS = """
select d.doc_id+1 as item_id, cast(cast(substring(d.source,4) as int)+1 as bigint) as feed_id,
 md5(d.text) as guid,
 case when d.doc_id%10=0 then concat('https://www.youtube.com/watch?v=',lpad(cast(d.doc_id as string),11,'0'))
      else concat('https://',d.source,'.example/p/',cast(d.doc_id as string)) end as url,
 substring(d.text,1,60) as title, case when d.doc_id%3=0 then d.source end as author,
 case when d.doc_id%5=0 then null else substring(d.text,1,400) end as summary, d.text as content,
 case when d.doc_id%11=0 then null
  else cast('2024-01-01 00:00:00' as timestamp) + ((d.doc_id*37)%43200) * interval '1' minute end as published_at,
 cast('2024-01-31 00:00:00' as timestamp) + (d.doc_id%60) * interval '1' second as fetched_at,
 coalesce(l.quality,0) as is_read, coalesce(l.toxic,0) as is_starred,
 case when l.quality=1 then cast('2024-01-31 01:00:00' as timestamp) end as read_at
from {documents} d left join {labels} l on l.doc_id=d.doc_id
"""

POLLS = """
select event_id as poll_id, user_id as feed_id, cast(ts as timestamp) as polled_at,
 case event_type when 'error' then 'error' when 'view' then 'not-modified' else 'ok' end as status,
 cast(floor(value) as int) as n_items from {events}
"""

PROBES = """
select lpad(cast(event_id as string),11,'0') as video_id, user_id as feed_id, cast(floor(value) as int) as seconds,
 case event_type when 'click' then 200 when 'view' then 303 when 'signup' then 303 when 'purchase' then null
  else 429 end as http_status,
 case event_type when 'view' then '/watch?v=x' when 'signup' then '/consent' end as location from {events}
"""

VERDICTS = """
select video_id, case when http_status=200 then 1 else 0 end as is_short
from (""" + PROBES + """) p where http_status in (200, 303)
"""

ACTIONS = """
select event_id as action_id, cast(ts as timestamp) as ts, event_id % (select count(*) from {documents}) + 1 as item_id,
 user_id % 20 + 1 as feed_id,
 case event_type when 'click' then 'open' when 'view' then 'mark-read' when 'signup' then 'star'
   when 'purchase' then 'mark-read' else 'mark-all' end as act,
 case when event_type='purchase' then 0 else 1 end as state from {events}
"""

RUNS = """
select cast((day(slot)-1)*24 + hour(slot) + 1 as bigint) as run_id, slot as started_at,
 slot + interval '3' minute as finished_at
from (select distinct date_trunc('hour', cast(ts as timestamp)) as slot from {events}) t
"""

# One landed response per document: a spread of statuses, types and bodies.
LANDED = """
select doc_id+1 as fetch_id, cast(cast(substring(source,4) as int)+1 as bigint) as feed_id,
 case doc_id%13 when 0 then 304 when 1 then 403 when 2 then 500 when 3 then null else 200 end as status,
 case when doc_id%13=3 then 'timed out' end as network_error,
 case doc_id%7 when 0 then 'application/rss+xml' when 1 then 'text/html; charset=utf-8' when 2 then ''
   when 3 then 'application/json' when 4 then 'text/xml' when 5 then 'text/plain' else 'application/atom+xml' end
   as content_type,
 case doc_id%5 when 0 then concat('<?xml version="1.0"?>', text) when 1 then concat('  <RSS version="2.0">', text)
   when 2 then concat(chr(123), '"items":[]', chr(125), text) when 3 then concat(' <feedback>', text) else text end as body,
 concat('W/"', cast(doc_id as string), '"') as etag,
 case when doc_id%2=0 then 'Mon, 01 Jan 2024 00:00:00 GMT' end as last_modified,
 case when doc_id%3=0 then 'W/"old"' end as sent_etag
from {documents}
"""

# The last poll of every feed, with what it brought.
OUTCOMES = """
select feed_id, max_by(status, poll_id) as status,
 case when max_by(status, poll_id)='error' then concat('HTTP ', cast(max_by(n_items, poll_id) % 200 + 400 as string))
  end as error,
 concat('W/"', cast(max(poll_id) as string), '"') as etag, cast(null as string) as last_modified,
 case when feed_id%2=1 then concat('Fetched ', cast(feed_id as string)) end as feed_title,
 concat('https://site', cast(feed_id as string), '.example') as site_url, max_by(n_items, poll_id) as n_items
from (""" + POLLS + """) p group by feed_id
"""

# Folder moves and renames by feed; a third of them retitle as well.
EDITS = """
select event_id as action_id, user_id % 20 + 1 as feed_id,
 case when event_type in ('signup','click') then 'update-feed' else 'set-folder' end as act,
 concat('Renamed ', cast(event_id as string)) as title,
 case event_type when 'view' then null when 'error' then 'Errors' else concat('F', cast(event_id%7 as string)) end
  as folder
from {events}
"""

# Subscription requests: one per page, many for the same address.
REQUESTS = """
select page_id as request_id, concat('https://src', cast(page_id%40 as string), '.example/feed') as feed_url,
 concat('https://src', cast(page_id%40 as string), '.example') as site_url,
 case when page_id%3=0 then '' else concat('Site ', cast(page_id%40 as string), ' by ', url) end as title,
 case when page_id%4=0 then 'News' when page_id%4=1 then '' end as folder
from {pages}
"""

# Landed pages: a spread of statuses, types and announced sizes.
PAGE_FETCHES = """
select page_id, url, html as body, case page_id%11 when 0 then 304 when 1 then 404 when 2 then null else 200 end as status,
 case when page_id%11=2 then 'reset' end as network_error,
 case page_id%5 when 0 then 'text/html; charset=utf-8' when 1 then '' when 2 then 'application/json'
  when 3 then 'text/plain' else 'application/xhtml+xml' end as content_type,
 case when page_id%17=5 then cast(9000000 as bigint) else cast(length(html) as bigint) end as content_length,
 concat('W/"', cast(page_id as string), '"') as etag, cast(null as string) as last_modified
from {pages}
"""

VIEWS = {"feeds": FEEDS, "items": ITEMS, "polls": POLLS, "probes": PROBES, "verdicts": VERDICTS, "actions": ACTIONS,
         "runs": RUNS, "landed": LANDED, "outcomes": OUTCOMES, "edits": EDITS, "requests": REQUESTS,
         "page_fetches": PAGE_FETCHES}
SOURCES = ("documents", "labels", "pages", "events", "nation")


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the named views, as text for the checking engine."""
    plain = {s: s for s in SOURCES}
    ctes = ",\n".join(f"{n}_v as ({VIEWS[n].format(**plain)})" for n in names)
    if not names:
        return sql
    for opening in ("with recursive ", "with "):
        if sql.startswith(opening):
            return f"{opening}{ctes},\n{sql[len(opening):]}"
    return f"with {ctes}\n{sql}"


class Tables:
    """Lazy views over one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        # Every time in these tables is UTC, whatever zone the session came with.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        return self.spark.sql(sql, **{s: self.read(s) for s in SOURCES if "{" + s + "}" in sql})

    def _spread(self, name: str) -> DataFrame:
        """A view over documents whose few file splits are spread over all cores first, for heavy per-row work."""
        given = {s: self.read(s) for s in SOURCES if "{" + s + "}" in VIEWS[name]}
        given["documents"] = spread_small(given["documents"], "doc_id")
        return self.spark.sql(VIEWS[name], **given)

    documents = cached_property(lambda self: self.read("documents"))
    pages = cached_property(lambda self: self.read("pages"))
    events = cached_property(lambda self: self.read("events"))
    feeds = cached_property(lambda self: self._view("feeds"))
    items = cached_property(lambda self: self._view("items"))
    text_items = cached_property(lambda self: self._spread("items"))
    polls = cached_property(lambda self: self._view("polls"))
    probes = cached_property(lambda self: self._view("probes"))
    verdicts = cached_property(lambda self: self._view("verdicts"))
    actions = cached_property(lambda self: self._view("actions"))
    runs = cached_property(lambda self: self._view("runs"))
    landed = cached_property(lambda self: self._view("landed"))
    outcomes = cached_property(lambda self: self._view("outcomes"))
    edits = cached_property(lambda self: self._view("edits"))
    requests = cached_property(lambda self: self._view("requests"))
    page_fetches = cached_property(lambda self: self._view("page_fetches"))
