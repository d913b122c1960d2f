"""Queries of the polling side: outcomes, ingest, retention, feed state, short videos, actions, subscriptions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom.operators import actions, ingest, outcome, retention, shorts, state
from feedloom.plans.bindings import Tables
from feedloom.plans.reading import NOW_TS, now
from feedloom.plans.registry import query
from feedloom.schemas import MAX_PAGE_BYTES

CAP = 20  # the smallest tables hold fewer rows per feed than the default cap

# --- outcomes

_SNIFF = """((contains(content_type,'json') and starts_with(ltrim(body,chr(65279)||' '||chr(9)||chr(10)||chr(13)),'{'))
 or regexp_matches(ltrim(body,chr(65279)||' '||chr(9)||chr(10)||chr(13)),'^(<\\?xml|<rss\\b|<feed\\b|<rdf:RDF\\b)','i')
 or regexp_matches(content_type,'application/(rss|atom|feed)\\+|(^|/)xml','i'))"""

query("looks_like_feed", f"select fetch_id, {_SNIFF} as is_feed from landed_v", "landed")(
    lambda t: t.landed.select("fetch_id", outcome.looks_like_feed(F.col("body"), F.col("content_type")).alias("is_feed")))

_TYPE = "case when content_type='' then 'no content-type' else content_type end"
query("fetch_outcome_feed", f"""select fetch_id, case when e is not null then 'error' when status=304 then 'not-modified'
 else 'ok' end as status, e as error, case when e is null then case when status=304 then sent_etag else etag end end as etag,
 case when e is null and status<>304 then last_modified end as last_modified
from (select *, case when network_error is not null then 'Network error: '||network_error when status=304 then null
 when status not between 200 and 299 then 'HTTP '||status
 when not {_SNIFF} then 'Response was not a feed (HTTP '||status||', '||{_TYPE}||')' end as e from landed_v)""", "landed")(
    lambda t: outcome.classify_feed(t.landed).select("fetch_id", "status", "error", "etag", "last_modified"))

_NAV = """len(regexp_extract_all(body,'<li><a href="[^"]*">'))"""


def nav_items(html: str = "body"):
    """How many list entries of the site menu a page holds."""
    return F.size(F.regexp_extract_all(html, F.lit('<li><a href="[^"]*">'), F.lit(0)))


query("fetch_outcome_scrape", f"""select page_id, case when e is not null then 'error' when status=304 then 'not-modified'
 else 'ok' end as status, e as error, case when e is null and status<>304 then etag end as etag, n
from (select *, {_NAV} as n, case when network_error is not null then 'Network error: '||network_error
 when status=304 then null when status not between 200 and 299 then 'HTTP '||status
 when content_length>4000000 then 'Could not read the page: Error: page announces 9MB, over the 4MB scrape limit'
 when not (regexp_matches(content_type,'html','i') or regexp_matches(body,'^\\s*<(!doctype|html)','i'))
  then 'Response was not an HTML page (HTTP '||status||', '||{_TYPE}||')'
 when {_NAV}=0 then 'The scrape rule matched nothing on that page (item selector: li)' end as e from page_fetches_v)""",
      "page_fetches")(
    lambda t: outcome.classify_scrape(t.page_fetches.withColumn("n", nav_items()), F.col("n"), F.lit("li"), max_bytes=MAX_PAGE_BYTES)
    .select("page_id", "status", "error", "etag", F.col("n").cast("bigint").alias("n")))

# --- ingest and retention


def batch(t: Tables) -> DataFrame:
    """All items as one poll per feed, in id order."""
    return t.items.withColumn("feed_pos", F.col("item_id"))


def stored(t: Tables) -> DataFrame:
    return t.items.filter("is_read = 1")


def fresh(t: Tables) -> DataFrame:
    return ingest.new_items(batch(t), stored(t), t.verdicts, ["feed_id"], CAP)


_NOT_SHORT = """not exists (select 1 from verdicts_v v where v.is_short=1
 and v.video_id=regexp_extract(i.url,'watch\\?v=([0-9A-Za-z_-]{11})',1))"""
_TOP = f"""select * from (select i.*, row_number() over (partition by feed_id order by published_at desc nulls last,
 item_id) as r from items_v i where {_NOT_SHORT}) where r<={CAP}"""
_NEW = f"""select * from (select *, row_number() over (partition by feed_id, guid order by published_at asc nulls first,
 item_id desc) as w from ({_TOP})) x where w=1
 and not exists (select 1 from items_v s where s.is_read=1 and s.feed_id=x.feed_id and s.guid=x.guid)"""

query("ingest_without_shorts", f"select item_id, feed_id, guid from items_v i where {_NOT_SHORT}", "items verdicts")(
    lambda t: ingest.without_shorts(t.items, t.verdicts).select("item_id", "feed_id", "guid"))
query("ingest_top_n", f"""select item_id, feed_id, guid, published_at from (select i.*, row_number() over (partition by
 feed_id order by published_at desc nulls last, item_id) as r from items_v i) where r<={CAP}""", "items")(
    lambda t: ingest.newest_per_poll(batch(t), ["feed_id"], CAP).select("item_id", "feed_id", "guid", "published_at"))
query("ingest_new_items", f"""select item_id, feed_id, guid, url, title, author, summary, content, published_at
from ({_NEW})""", "items verdicts")(
    lambda t: fresh(t).select("item_id", "feed_id", "guid", "url", "title", "author", "summary", "content", "published_at"))


@query("replay_is_noop", f"select (select count(*) from ({_NEW})) as first_time, cast(0 as bigint) as replayed",
       "items verdicts")
def _replay(t: Tables) -> DataFrame:
    first = fresh(t)
    after = stored(t).select("feed_id", "guid").unionByName(first.select("feed_id", "guid"))
    again = ingest.new_items(batch(t), after, t.verdicts, ["feed_id"], CAP)
    marked = first.select(F.lit(0).alias("again")).unionByName(again.select(F.lit(1).alias("again")))
    return marked.agg(F.count_if(F.col("again") == 0).alias("first_time"), F.count_if(F.col("again") == 1).alias("replayed"))


# Feed ids spread over all 64 bits, as hashes of addresses would be.
_WIDE = 72_057_594_037_927_931
query("ingest_ids", f"""select feed_id, guid, published_at, row_number() over (order by published_at asc nulls first, pos desc, feed_id, guid)
 + (select max(item_id) from items_v) as item_id from (select *, item_id as pos from ({_NEW}))""", "items verdicts")(
    lambda t: ingest.with_ids(fresh(t).drop("item_id").withColumn("feed_id", F.col("feed_id") * F.lit(_WIDE)), t.items).select(
        F.expr(f"feed_id div {_WIDE}L").alias("feed_id"), "guid", "published_at", "item_id"))

query("retention", f"""select item_id, feed_id, is_starred, is_read from (select *, row_number() over (partition by feed_id
 order by coalesce(published_at,fetched_at) desc, item_id desc) as r from items_v) where r<={CAP} or is_starred=1""",
      "items")(lambda t: retention.retention(t.items, CAP).select("item_id", "feed_id", "is_starred", "is_read"))

# --- feed state

_JUDGED = """select o.*, f.kind, f.last_item_count as before, coalesce(o.status='ok' and f.kind='scrape'
 and f.last_item_count>=4 and o.n_items < f.last_item_count*0.5, false) as decayed
from outcomes_v o join feeds_v f on f.feed_id=o.feed_id"""
query("feed_state_next", f"""select f.feed_id, f.feed_url, f.folder, f.kind,
 case when j.feed_id is null then f.etag when j.status='not-modified' then f.etag
  when j.status='ok' and not j.decayed then j.etag end as etag,
 case when j.feed_id is null or j.status='not-modified' then f.last_modified end as last_modified,
 case when j.feed_id is null then f.last_polled_at else {NOW_TS} end as last_polled_at,
 case when j.feed_id is null then f.last_status when j.decayed then 'error' else j.status end as last_status,
 case when j.feed_id is null then f.last_error when j.decayed then concat('The scrape rule now matches ', j.n_items,
  ' of the ', j.before, ' items it last found; check the page''s markup.') when j.status='error' then j.error end as last_error,
 cast(case when j.feed_id is null then f.error_count when j.status='error' or j.decayed then f.error_count+1 else 0 end
  as bigint) as error_count,
 case when j.status='ok' and f.title='' and coalesce(j.feed_title,'')<>'' then j.feed_title else f.title end as title,
 case when j.status='ok' then coalesce(f.site_url, j.site_url) else f.site_url end as site_url,
 cast(case when j.status='ok' and not j.decayed and f.kind='scrape' then j.n_items else f.last_item_count end as bigint)
  as last_item_count
from feeds_v f left join ({_JUDGED}) j on j.feed_id=f.feed_id""", "feeds outcomes")(
    lambda t: state.next_feed_state(t.feeds, t.outcomes, now()))


@query("run_stats", f"""select * replace (case when unclassified>0 then concat(unclassified,
 ' YouTube video(s) still unclassified, carried to the next poll') end as note) from (select count(*) as feeds, count(*) filter (where status='ok' and not decayed) as ok,
 count(*) filter (where status='not-modified') as not_modified, count(*) filter (where status='error' or decayed) as errored,
 (select count(*) from ({_NEW})) as inserted,
 (select count(*) from items_v i join feeds_v f on f.feed_id=i.feed_id where contains(f.feed_url,'youtube.com/feeds')
  and not {_NOT_SHORT}) as shorts_swept,
 (select count(*) from (select distinct i.feed_id, i.url from items_v i join feeds_v f on f.feed_id=i.feed_id
  where contains(f.feed_url,'youtube.com/feeds') and contains(i.url,'watch?v=') and not exists (select 1 from verdicts_v v
  where v.video_id=right(i.url,11)))) as unclassified,
 cast(null as varchar) as note
from ({_JUDGED}))""", "feeds outcomes items verdicts")
def _run_stats(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return state.run_stats(state.judged(t.feeds, t.outcomes), fresh(t).agg(n).scalar(),
                           shorts.doomed(t.items, t.feeds, t.verdicts).agg(n).scalar(),
                           shorts.unclassified(t.items, t.feeds, t.verdicts).scalar())


query("error_streaks", """select poll_id, feed_id, status, case when status='error' then
 row_number() over (partition by feed_id, island order by polled_at, poll_id)
 - case when island>0 then 1 else 0 end else 0 end as error_count
from (select *, count(*) filter (where status<>'error') over (partition by feed_id order by polled_at, poll_id) as island
 from polls_v)""", "polls")(lambda t: state.error_streaks(t.polls))

query("scrape_decay", """with recursive ordered as (select *, row_number() over (partition by feed_id
  order by polled_at, poll_id) as k from polls_v where status='ok'),
walk as (select poll_id, feed_id, n_items, k, cast(null as int) as before, false as decayed, n_items as after
  from ordered where k=1
 union all select o.poll_id, o.feed_id, o.n_items, o.k, w.after, w.after>=4 and o.n_items<w.after*0.5,
  case when w.after>=4 and o.n_items<w.after*0.5 then w.after else o.n_items end
  from walk w join ordered o on o.feed_id=w.feed_id and o.k=w.k+1)
select poll_id, feed_id, n_items, cast(before as bigint) as before, decayed from walk""", "polls")(
    lambda t: state.scrape_decay(t.polls))

query("poll_windows", """select time_bucket(interval '20 minutes', polled_at) as window_start, count(*) as polls,
 count(*) filter (where status='ok') as ok, count(*) filter (where status='not-modified') as not_modified,
 count(*) filter (where status='error') as errored from polls_v group by 1""", "polls")(
    lambda t: state.poll_windows(t.polls))

# --- short videos

_VERDICT = """case when http_status between 300 and 399 and contains(coalesce(location,''),'/watch') then 0
 when http_status=200 then 1 end"""
_STORED = """select i.item_id, i.feed_id, regexp_extract(i.url,'watch\\?v=([0-9A-Za-z_-]{11})',1) as video_id
from items_v i join feeds_v f on f.feed_id=i.feed_id where contains(f.feed_url,'youtube.com/feeds/videos.xml')
 and contains(i.url,'watch?v=')"""
_UNKNOWN = f"""select feed_id, video_id, min(item_id) as item_id from ({_STORED}) s
where not exists (select 1 from verdicts_v v where v.video_id=s.video_id) group by 1,2"""

query("shorts_unknown", _UNKNOWN, "items feeds verdicts")(
    lambda t: shorts.unknown_videos(t.items, t.feeds, t.verdicts).select("feed_id", "video_id", "item_id"))
query("shorts_unclassified", f"select count(*) as unclassified from ({_UNKNOWN})", "items feeds verdicts")(
    lambda t: shorts.unclassified(t.items, t.feeds, t.verdicts))
query("shorts_candidates", "select video_id, feed_id, seconds from probes_v where seconds>0 and seconds<=195", "probes")(
    lambda t: shorts.candidates(t.probes).select("video_id", "feed_id", "seconds"))
query("shorts_surface", f"select video_id, {_VERDICT} as is_short from probes_v", "probes")(
    lambda t: t.probes.select("video_id", shorts.surface_verdict(F.col("http_status"), F.col("location")).alias("is_short")))
query("shorts_classify", f"""select video_id, is_short from (select video_id, case when seconds>0 and seconds<=195
 then {_VERDICT} else 0 end as is_short from probes_v) where is_short is not null""", "probes")(
    lambda t: shorts.classify(t.probes))
query("shorts_classify_keyless", f"""select video_id, is_short from (select video_id, {_VERDICT} as is_short from probes_v)
where is_short is not null""", "probes")(lambda t: shorts.classify(t.probes, keyed=False))
query("shorts_sweep", f"""select item_id, feed_id from items_v where item_id not in (select item_id from ({_STORED}) s
 join verdicts_v v on v.video_id=s.video_id where v.is_short=1)""", "items feeds verdicts")(
    lambda t: shorts.sweep(t.items, t.feeds, t.verdicts).select("item_id", "feed_id"))
query("upsert_verdicts", f"""select video_id, is_short from verdicts_v where video_id not in (select video_id from probes_v
 where seconds<=0 or seconds>195 or ({_VERDICT}) is not null)
union all select video_id, is_short from (select video_id, case when seconds>0 and seconds<=195 then {_VERDICT} else 0 end
 as is_short from probes_v) where is_short is not null""", "probes verdicts")(
    lambda t: shorts.upsert_verdicts(t.verdicts, shorts.classify(t.probes)))

_WORK = "select video_id, feed_id, cast(cast(video_id as int) as bigint) as item_id from probes_v"


def work(t: Tables) -> DataFrame:
    """Every probed video as work still to do, in event order."""
    return t.probes.select("video_id", "feed_id", F.col("video_id").cast("bigint").alias("item_id"))


query("probe_plan", f"""select feed_id, video_id, rank from (select *, row_number() over (partition by feed_id
 order by item_id) as rank from ({_WORK})) where rank<=40 order by feed_id, rank limit 200""", "probes")(
    lambda t: shorts.probe_plan(work(t)))
query("api_batches", f"""select feed_id, batch, string_agg(video_id, ',' order by item_id) as ids, count(*) as n
from (select *, (row_number() over (partition by feed_id order by item_id)-1)//50 as batch from ({_WORK})) group by 1,2""",
      "probes")(lambda t: shorts.api_batches(work(t)))

# --- actions and subscriptions

_ARRIVED = "coalesce(i.published_at,i.fetched_at)"
query("apply_actions", f"""with own as (select *, row(ts, action_id) as seq from actions_v where act<>'mark-all'),
u as (select i.item_id, i.feed_id, i.is_read, i.is_starred, i.read_at, {_ARRIVED} as arrived, l.unread_at, l.star
 from items_v i left join (select item_id, max(case when act='mark-read' and state=0 then seq end) as unread_at,
  arg_max(state, seq) filter (where act='star') as star from own group by 1) l on l.item_id=i.item_id),
r as (select u.item_id, min(o.seq) as first_read, max(case when o.act='mark-read' then o.seq end) as stamp
 from u join own o on o.item_id=u.item_id where o.act in ('open','mark-read') and not (o.act='mark-read' and o.state=0)
 and (u.unread_at is null or o.seq>u.unread_at) group by 1),
m as (select u.item_id, min(a.ts) as marked_at from u join actions_v a on a.feed_id=u.feed_id and a.act='mark-all'
 and a.ts>=u.arrived and (u.unread_at is null or row(a.ts, a.action_id)>u.unread_at) group by 1),
s as (select u.*, r.first_read, r.stamp, m.marked_at, (u.is_read=1 and u.unread_at is null) as stays
 from u left join r on r.item_id=u.item_id left join m on m.item_id=u.item_id)
select item_id, case when stays or first_read is not null or marked_at is not null then 1 else 0 end as is_read,
 coalesce(star, is_starred) as is_starred,
 case when stamp is not null then stamp.ts when stays then read_at else least(first_read.ts, marked_at) end as read_at
from s""".replace("row(ts, action_id)", "{'ts': ts, 'action_id': action_id}").replace(
    "row(a.ts, a.action_id)", "{'ts': a.ts, 'action_id': a.action_id}"), "items actions")(
    lambda t: actions.apply_actions(t.items, t.actions, t.feeds, F.coalesce("published_at", "fetched_at")))

query("apply_feed_edits", """select f.feed_id, coalesce(r.title, f.title) as title, e.folder
from feeds_v f join (select feed_id, arg_max({'v': folder}, action_id).v as folder from edits_v group by 1) e
 on e.feed_id=f.feed_id left join (select feed_id, arg_max(title, action_id) as title from edits_v where act='update-feed'
 group by 1) r on r.feed_id=f.feed_id
union all select feed_id, title, folder from feeds_v where feed_id not in (select feed_id from edits_v)""", "feeds edits")(
    lambda t: actions.apply_feed_edits(t.feeds, t.edits).select("feed_id", "title", "folder"))


@query("delete_feeds", """select i.item_id, i.feed_id, f.feed_url from items_v i join feeds_v f on f.feed_id=i.feed_id
where f.last_status is null or f.last_status<>'error'""", "items feeds")
def _delete_feeds(t: Tables) -> DataFrame:
    feeds, items = actions.delete_feeds(t.feeds, t.items, t.feeds.filter("last_status = 'error'"))
    return items.join(feeds, "feed_id").select("item_id", "feed_id", "feed_url")


_ASKED = """select page_id as request_id, case page_id%6 when 0 then 'NEWS' when 1 then 'téch' when 2 then ' Sçience '
 when 3 then '' when 4 then 'Brand new' end as folder_new, case when page_id%2=0 then 'Tech' end as folder from {pages}"""
query("canonical_folder", f"""select request_id, coalesce((select min(f.folder) from feeds_v f
 where strip_accents(lower(f.folder))=strip_accents(lower(trim(a.folder_new)))), nullif(trim(a.folder_new),''), folder)
 as folder from ({_ASKED.format(pages='pages')}) a""", "feeds")(
    lambda t: actions.canonical_folders(t.spark.sql(_ASKED, pages=t.pages), t.feeds))

_LABEL = "coalesce(nullif(left({0},200),''), feed_url)"
query("add_feeds", f"""with w as (select feed_url, min(request_id) as first_id, arg_min({{'v': left(title,200)}}, request_id).v
  as w_title, arg_min({{'v': nullif(folder,'')}}, request_id).v as w_folder from requests_v group by 1),
x as (select r.request_id, r.feed_url, r.site_url, left(r.title,200) as title, nullif(trim(r.folder),'') as folder,
 case when f.feed_url is null then w_title else f.title end as t, case when f.feed_url is null then w_folder else f.folder end
 as p, f.feed_url is null and r.request_id=w.first_id as is_new
 from requests_v r join w on w.feed_url=r.feed_url left join feeds_v f on f.feed_url=r.feed_url)
select request_id, feed_url, site_url, title, folder, case when is_new then 'added' else 'already' end as result,
 case when is_new then {_LABEL.format('title')} || coalesce(' → '||folder,'')
  else 'Already subscribed: ' || {_LABEL.format('t')} || case when coalesce(trim(p),'')<>'' then ' (in '||trim(p)||')'
  else ' (ungrouped)' end || '. Change its folder from Manage feeds.' end as message from x""", "feeds requests")(
    lambda t: actions.add_feeds(t.requests, t.feeds))
