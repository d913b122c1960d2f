"""Queries of the reading side: lists, counts, folders, health panels, feed selection."""
from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import feeds, lists, summary
from feedloom.plans.bindings import NOW
from feedloom.plans.registry import query

NOW_TS = f"cast('{NOW}' as timestamp)"
now = lambda: F.lit(NOW).cast("timestamp")

_COLS = """i.item_id, i.feed_id, i.url, i.title, i.author, i.summary, i.content, i.published_at, i.fetched_at,
 i.is_read, i.is_starred, f.title as feed_title, f.site_url as feed_site"""
_PAGE = f"""select {_COLS} from items_v i join feeds_v f on f.feed_id=i.feed_id {{where}}
order by coalesce(i.published_at,i.fetched_at) desc, i.item_id desc limit 100 offset {{offset}}"""


def _page(where: str = "", offset: int = 0) -> str:
    return _PAGE.format(where=where, offset=offset)


IN_FOLDER = "i.feed_id in (select feed_id from feeds_v where folder='News')"

query("list_unread", _page("where i.is_read=0"), "feeds items")(lambda t: lists.list_items(t.items, t.feeds, "unread"))
query("list_all", _page(), "feeds items")(lambda t: lists.list_items(t.items, t.feeds, "all"))
query("list_starred", _page("where i.is_starred=1"), "feeds items")(
    lambda t: lists.list_items(t.items, t.feeds, "starred"))
query("list_feed", _page("where i.is_read=0 and i.feed_id=3"), "feeds items")(
    lambda t: lists.list_items(t.items, t.feeds, "unread", feed_id=3, folder="News"))
query("list_folder", _page(f"where i.is_read=0 and {IN_FOLDER}"), "feeds items")(
    lambda t: lists.list_items(t.items, t.feeds, "unread", folder="News"))
query("list_page2", _page("", 100), "feeds items")(lambda t: lists.list_items(t.items, t.feeds, "all", page=1))
query("list_count", "select count(*) as n, false as has_prev, count(*) > 100 as has_next from items_v i "
      f"where i.is_read=0 and {IN_FOLDER}", "feeds items")(
    lambda t: lists.count_items(t.items, t.feeds, "unread", folder="News").select("n", *lists.page_state(F.col("n"), 0)))

query("list_after", _PAGE.format(where="""where coalesce(i.published_at,i.fetched_at) < timestamp '2024-01-20 00:00:00'
 or (coalesce(i.published_at,i.fetched_at) = timestamp '2024-01-20 00:00:00' and i.item_id < 500)""", offset=0),
      "feeds items")(
    lambda t: lists.list_items(t.items, t.feeds, "all", after=("2024-01-20 00:00:00", 500)))

query("item_by_id", f"""select {_COLS} from items_v i join feeds_v f on f.feed_id=i.feed_id
where i.item_id in (select item_id from actions_v where act='open')""", "feeds items actions")(
    lambda t: lists.items_by_id(t.items, t.feeds, t.actions.filter("act = 'open'")))

# Title and author carry no markup in these tables, so the checking side squeezes and skips the tag removal.
_WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def sql_decode(expr: str) -> str:
    """The reader's decoder for texts without numeric references."""
    out = f"regexp_replace({expr},'&nbsp;',' ','gi')"
    for pattern, char in (("&quot;", '"'), ("&#39;|&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"regexp_replace({out},'{pattern}','{char}','gi')"
    return out


def sql_strip(expr: str) -> str:
    bare = expr
    for tag in ("script", "style"):
        bare = rf"regexp_replace({bare},'<{tag}[\s\S]*?</{tag}>',' ','gi')"
    return f"trim(regexp_replace({sql_decode(f'''regexp_replace({bare},'<[^>]+>',' ','g')''')},'{_WS}',' ','g'))"


def sql_excerpt(expr: str, n: int = 260) -> str:
    return f"case when length({expr})>{n} then concat(rtrim(left({expr},{n})),'…') else {expr} end"


def _age(expr: str) -> str:
    minutes = f"floor((epoch_us({NOW_TS})-epoch_us({expr}))/60000000.0+0.5)"
    hours = f"floor({minutes}/60.0+0.5)"
    days = f"floor({hours}/24.0+0.5)"
    text = lambda e: f"cast(cast({e} as bigint) as varchar)"
    return f"""case when {expr} is null then '' when {minutes}<1 then 'now' when {minutes}<60 then {text(minutes)}||'m'
 when {hours}<24 then {text(hours)}||'h' when {days}<7 then {text(days)}||'d'
 else strftime({expr},'%-d %b') end"""


query("item_cards", f"""select item_id, feed_id, case when t='' then '(untitled)' else t end as title,
 case when a<>coalesce(ft,'') then a end as author, coalesce(nullif(ft,''),'feed') as source,
 case when vid<>'' then '/rss/watch?v='||vid else url end as link, vid<>'' as is_video,
 {sql_excerpt('b')} as excerpt, {_age('shown_at')} as age, is_read, is_starred
from (select i.item_id, i.feed_id, {sql_strip('i.title')} as t, {sql_strip('i.author')} as a, f.title as ft, i.url,
 regexp_extract(i.url,'watch\\?v=([0-9A-Za-z_-]{{11}})',1) as vid,
 {sql_strip("coalesce(nullif(i.summary,''),i.content)")} as b, coalesce(i.published_at,i.fetched_at) as shown_at,
 i.is_read, i.is_starred from items_v i join feeds_v f on f.feed_id=i.feed_id)""", "feeds items")(
    lambda t: lists.item_cards(lists.with_feed(t.text_items, t.feeds), now()))

_INLINE = _WS.replace(r"\s\x{0B}", r"\t\x0B\f\r ")
query("item_views", f"""select i.item_id, i.feed_id, {sql_strip('i.title')} as title, f.site_url as site,
 array_to_string(list_filter(list_transform(string_split_regex({sql_decode("regexp_replace(i.content,'<[^>]+>',' ','g')")}, '\n{{2,}}'),
  lambda p: regexp_replace(regexp_replace(regexp_replace(p, '{_INLINE}', ' ', 'g'), ' *\n *', chr(10), 'g'),
  '^[ \n]+|[ \n]+$', '', 'g')), lambda p: p<>''), '¶') as body, cast(0 as bigint) as links
from items_v i join feeds_v f on f.feed_id=i.feed_id""", "feeds items")(
    lambda t: lists.item_views(lists.with_feed(t.text_items, t.feeds), now()).select(
        "item_id", "feed_id", "title", "site", F.array_join("paragraphs", "¶").alias("body"),
        F.size("links").cast("bigint").alias("links")))

# --- counts and folders

_ROWS = """select f.*, trim(coalesce(f.folder,'')) as fname, coalesce(nullif(f.title,''),f.feed_url) as label,
 coalesce(c.held,0) as held, coalesce(c.unread,0) as unread, coalesce(f.last_status='error',false) as erroring,
 coalesce(f.last_status<>'error',false) and coalesce(c.held,0)=0 as silent
from feeds_v f left join (select feed_id, count(*) as held, count(*) filter (where is_read=0) as unread
 from items_v group by 1) c on c.feed_id=f.feed_id"""
_STATUS = "case when erroring then 'error' when last_status is not null then 'ok' else 'new' end"
_BADGE = "case when {0}>999 then '999+' when {0}=0 then '' else cast({0} as varchar) end"

query("unread_by_feed", "select feed_id, count(*) as n from items_v where is_read=0 group by 1", "items")(
    lambda t: summary.unread_by_feed(t.items))
query("held_by_feed", "select feed_id, count(*) as n from items_v group by 1", "items")(
    lambda t: summary.held_by_feed(t.items))
query("unread_total", "select count(*) as unread from items_v where is_read=0", "items")(
    lambda t: summary.unread_total(t.items))
query("manage_rows", f"""select feed_id, feed_url, label, fname as folder, last_status, site_url as site, held, unread,
 {_STATUS} as status, erroring, silent, case when erroring then last_error end as error_text from ({_ROWS})""",
      "feeds items")(lambda t: summary.manage_rows(t.feeds, t.items))
query("silent_feeds", f"select feed_id, feed_url, label, last_status from ({_ROWS}) where silent", "feeds items")(
    lambda t: summary.silent_feeds(t.feeds, t.items))
query("erroring_feeds", f"select feed_id, feed_url, label, last_error from ({_ROWS}) where erroring", "feeds items")(
    lambda t: summary.erroring_feeds(t.feeds))
query("sidebar", f"""select feed_id, fname as folder, label, unread, {_BADGE.format('unread')} as badge,
 case when erroring then 'err' when last_status is null then 'new' else '' end as dot from ({_ROWS})""", "feeds items")(
    lambda t: summary.sidebar(t.feeds, t.items))
query("sidebar_rollup", f"""select fname as folder, feed_id, cast(grouping(fname)*2+grouping(feed_id) as int) as level,
 count(*) as feeds, cast(sum(unread) as bigint) as unread, {_BADGE.format('sum(unread)')} as badge
from ({_ROWS}) group by rollup(fname, feed_id)""", "feeds items")(lambda t: summary.sidebar_rollup(t.feeds, t.items))
query("folder_summary", f"""select fname as folder, count(*) as feeds, cast(sum(unread) as bigint) as unread,
 count(*) filter (where erroring) as erroring, count(*) filter (where silent) as silent from ({_ROWS}) group by 1""",
      "feeds items")(lambda t: summary.folder_summary(t.feeds, t.items))
query("manage_tally", f"""select count(*) as feeds, count(distinct nullif(fname,'')) as folders,
 count(*) filter (where erroring) as erroring, count(*) filter (where silent) as silent from ({_ROWS})""",
      "feeds items")(lambda t: summary.manage_tally(t.feeds, t.items))
query("folders", "select distinct trim(folder) as folder from feeds_v where trim(coalesce(folder,''))<>''", "feeds")(
    lambda t: summary.folders(t.feeds))
query("folder_options", """select distinct trim(folder) as folder from feeds_v where folder is not null
union select distinct lang from documents""", "feeds")(
    lambda t: summary.folder_options(t.feeds, t.documents.select(F.col("lang").alias("folder"))))
query("feeds_by_folder", f"""select case when fname='' then 'Ungrouped' else fname end as section, feed_id, label,
 feed_url, {_STATUS} as status, held, unread from ({_ROWS})""", "feeds items")(
    lambda t: summary.feeds_by_folder(t.feeds, t.items))
query("error_panel", """select feed_id, coalesce(nullif(title,''),feed_url) as label, feed_url,
 coalesce(last_error,'no detail recorded') as why,
 greatest((select count(*) from feeds_v where last_status='error')-25,0) as more
from feeds_v where last_status='error' order by lower(title), feed_url limit 25""", "feeds")(
    lambda t: summary.error_panel(t.feeds))

# --- feeds and runs

query("scan_feeds", "select feed_id, title, feed_url, site_url, folder, last_status, last_error from feeds_v", "feeds")(
    lambda t: feeds.scan_feeds(t.feeds))
query("due_feeds", f"""select feed_id, feed_url, error_count, last_polled_at from feeds_v
where error_count<5 or last_polled_at is null or last_polled_at < {NOW_TS} - interval '360' minute""", "feeds")(
    lambda t: feeds.due_feeds(t.feeds, now()))
query("due_feeds_forced", "select feed_id, feed_url, error_count, last_polled_at from feeds_v", "feeds")(
    lambda t: feeds.due_feeds(t.feeds, now(), force=True))
query("latest_run", "select run_id, started_at, finished_at from runs_v order by run_id desc limit 1", "runs")(
    lambda t: feeds.latest_run(t.runs))
query("status_json", """select concat('{"poll":',run_id,',"started_at":"',strftime(started_at,'%Y-%m-%d %H:%M:%S'),
 '","finished_at":"',strftime(finished_at,'%Y-%m-%d %H:%M:%S'),'","unread":',
 (select count(*) from items_v where is_read=0),'}') as status from runs_v order by run_id desc limit 1""",
      "items runs")(lambda t: feeds.status_json(t.runs, t.items))
