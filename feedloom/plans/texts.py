"""Queries of the column functions and of search."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from feedloom.functions import dates, identity, text, urls
from feedloom.operators import search
from feedloom.operators.joins import spread_small
from feedloom.plans.bindings import Tables
from feedloom.plans.reading import NOW_TS, _WS, now, sql_decode, sql_excerpt, sql_strip
from feedloom.plans.registry import query
from feedloom.session import shared_dir, stored

# --- text


def docs(t: Tables) -> DataFrame:
    return spread_small(t.documents, "doc_id")


def page_rows(t: Tables) -> DataFrame:
    return spread_small(t.pages, "page_id")


query("esc_text", """select page_id, replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),
 '"','&quot;'),'''','&#39;') as escaped from pages""")(
    lambda t: page_rows(t).select("page_id", text.esc(F.col("html")).alias("escaped")))
query("strip_tags", f"select page_id, {sql_strip('html')} as plain from pages")(
    lambda t: page_rows(t).select("page_id", text.strip_tags(F.col("html")).alias("plain")))
query("excerpts", f"select page_id, {sql_excerpt('p')} as excerpt from (select page_id, {sql_strip('html')} as p from pages)")(
    lambda t: page_rows(t).select("page_id", text.excerpt(F.col("html")).alias("excerpt")))

# Every text gets references of each kind appended, so whole texts pass the decoders.
_TAIL = "' &lt;b&gt; &#65;&#x42;&#x1F600; &amp;lt; &nbsp;&quot;&#39;&apos; &#99999999999; &#38;#67; &hellip;&Eacute;&nope;'"
query("decode_entities", """select doc_id, concat(text, ' <b> AB😀 &lt;  "'''' ', ' &#67; &hellip;&Eacute;&nope;') as reader,
 concat(text, ' <b> AB😀 &lt;  "'''' &#99999999999; &#67; …é&nope;') as page from documents""")(
    lambda t: docs(t).select("doc_id", F.expr(f"concat(text, {_TAIL})").alias("c"))
    .select("doc_id", text.decode_entities(F.col("c")).alias("reader"), text.decode_page_entities(F.col("c")).alias("page")))

_INLINE = _WS.replace(r"\s\x{0B}", r"\t\x0B\f\r ").replace("]+", "]+")


@query("reading_blocks", f"""select page_id, generate_subscripts(ps, 1) as block_no, unnest(ps) as block from (
 select page_id, list_filter(list_transform(string_split_regex({sql_decode('marked')}, '\\n{{2,}}'), lambda p:
  regexp_replace(regexp_replace(regexp_replace(p, '{_INLINE}', ' ', 'g'), ' *\\n *', chr(10), 'g'),
   '^[ \\n]+|[ \\n]+$', '', 'g')), lambda p: p<>'') as ps
 from (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<script[\\s\\S]*?</script>', ' ', 'gi'), '<style[\\s\\S]*?</style>', ' ', 'gi'),
  '</(p|div|h[1-6]|li|blockquote|section|article|tr)>', chr(10)||chr(10), 'gi'), '<br\\s*/?>', chr(10), 'gi'),
  '<[^>]+>', ' ', 'g') as marked from pages))""")
def _blocks(t: Tables) -> DataFrame:
    blocks = page_rows(t).select("page_id", F.posexplode(text.reading_paragraphs(F.col("html"))).alias("n", "block"))
    return blocks.select("page_id", (F.col("n") + 1).cast("bigint").alias("block_no"), "block")


# Each page's menu links, made absolute, are the safe links of a body.
_ABSOLUTE = "regexp_replace(html, '<a href=\"/', concat('<A class=x href=''https://h', cast(page_id as string), '.example/'){})"
query("reading_links", """select page_id, generate_subscripts(w,1)-1 as link_no,
 concat('https://h', page_id, '.example/', unnest(w)) as url, unnest(w) as label
from (select page_id, regexp_extract_all(html, '<li><a href="/([^"]*)">', 1) as w from pages)""")(
    lambda t: page_rows(t).select("page_id", F.regexp_replace(F.col("html"), '<a href="/([^"]*)">', F.concat(
        F.lit("<A class=x href='https://h"), F.col("page_id").cast("string"), F.lit(".example/$1'>"))).alias("h"))
    .select("page_id", F.posexplode(text.reading_links(F.col("h"))).alias("n", "l"))
    .select("page_id", F.col("n").cast("bigint").alias("link_no"), "l.url", F.col("l.text").alias("label")))

_TITLE = r"regexp_extract(html,'<title[^>]*>([\s\S]*?)</title>',1,'i')"
query("page_titles", f"""select page_id, nullif(trim(regexp_replace({sql_decode(_TITLE)},'{_WS}',' ','g')),'') as title
from pages""")(
    lambda t: page_rows(t).select("page_id", text.page_title(F.col("html")).alias("title")))

# --- addresses

_FORMS = """case {n}%6 when 0 then concat('  HTTPS://a.example/', {n}) when 1 then 'javascript:x()' when 2 then ''
 when 3 then concat('http://b.example/', {n}, ' ') when 4 then concat('ftp://c.example/', {n}) end"""
query("safe_urls", f"""select doc_id, case when regexp_matches(trim(u),'^https?://','i') then trim(u) end as url
from (select doc_id, {_FORMS.format(n='doc_id')} as u from documents)""")(
    lambda t: t.documents.select("doc_id", F.expr(_FORMS.format(n="doc_id")).alias("u"))
    .select("doc_id", urls.safe_url(F.col("u")).alias("url")))

_VIDEO_FORMS = """case event_id%8 when 0 then 'https://www.youtube.com/watch?v=' when 1 then 'https://youtu.be/'
 when 2 then 'https://www.youtube-nocookie.com/embed/' when 3 then 'https://m.youtube.com/shorts/'
 when 4 then 'https://youtube.com/watch?list=1&v=' when 5 then 'https://www.YOUTUBE.com/v/'
 when 6 then 'https://vimeo.com/' else 'https://youtube.com/channel/' end"""
query("video_ids", """select event_id, case when event_id%8<6 then lpad(cast(event_id as varchar),11,'0') end as video_id
from events""")(
    lambda t: t.events.select("event_id", F.concat(F.expr(_VIDEO_FORMS), F.lpad(F.col("event_id").cast("string"), 11, "0"),
                                                   F.lit("&t=1")).alias("u"))
    .select("event_id", urls.video_id(F.col("u")).alias("video_id")))

_CHANNEL = """concat(case page_id%6 when 0 then '"channelId":"UCsidebar0000000000000000" "externalId":"UC'
 when 1 then '<link rel="canonical" href="https://www.youtube.com/channel/UC' when 2 then '/feeds/videos.xml?channel_id=UC'
 when 3 then '<meta itemprop="identifier" content="UC' when 4 then '"channelId":"UC' else '"channel":"UC' end,
 lpad(cast(page_id as string),22,'0'), '"')"""
query("channel_ids", """select page_id, case when page_id%6<5 then 'UC'||lpad(cast(page_id as varchar),22,'0') end as in_page,
 case when page_id%2=0 then 'UC'||lpad(cast(page_id as varchar),22,'0') end as in_url, page_id%3<2 as is_channel from pages""")(
    lambda t: t.pages.select("page_id", F.concat("html", F.expr(_CHANNEL)).alias("h"), F.expr(
        """concat(case page_id%3 when 0 then 'https://www.youtube.com' when 1 then 'http://M.YouTube.com' else
        'https://youtube.example' end, case when page_id%2=0 then '/channel/' else '/@' end, 'UC',
        lpad(cast(page_id as string),22,'0'))""").alias("u"))
    .select("page_id", urls.channel_id_in_page(F.col("h")).alias("in_page"),
            urls.channel_id_in_url(F.col("u")).alias("in_url"), urls.is_channel_url(F.col("u")).alias("is_channel")))

# --- identity and dates

_DJB2 = "'h:'||lower(to_hex(list_reduce(list_prepend(5381::bigint, list_transform(string_split({0},''), lambda c: " \
        "cast(unicode(c) as bigint))), lambda h, c: (h*33+c)&4294967295)))"
query("hash_guid", f"""select item_id, {_DJB2.format("concat(title,'|',strftime(fetched_at,'%Y-%m-%d'))")} as guid,
 {_DJB2.format("content")} as content_hash from items_v""", "items")(
    lambda t: t.text_items.select("item_id", identity.hash_guid(F.col("title"), F.date_format("fetched_at", "yyyy-MM-dd")).alias("guid"),
                             identity.hash_guid(F.col("content")).alias("content_hash")))

_RFC = "strftime(published_at,'%a, %d %b %Y %H:%M:%S GMT')"
query("item_identity", f"""select item_id, case when item_id%3=0 then guid when item_id%2=0 then url
 else {_DJB2.format("concat(title,'|',coalesce(strftime(published_at,'%Y-%m-%d'),'no date'))")} end as identity from items_v""",
      "items")(
    lambda t: t.items.select("item_id", identity.item_guid(
        F.expr("if(item_id%3=0, guid, '')"), F.col("url"), F.expr("if(item_id%2=0, 'https://feed.example', url)"),
        F.col("title"), F.coalesce(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("no date")))
        .alias("identity")))

_DATE_FORMS = """case item_id%9 when 0 then date_format(published_at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
 when 1 then date_format(published_at - interval '7' hour, "EEE, d MMM yyyy HH:mm:ss '-0700'")
 when 2 then date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
 when 3 then date_format(published_at + interval '150' minute, "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:30'")
 when 4 then date_format(published_at, "MMMM d, yyyy HH:mm:ss") when 5 then date_format(published_at, "dd MMM yy HH:mm")
 when 6 then date_format(published_at - interval '4' hour, "EEE, dd MMM yyyy HH:mm:ss 'EDT'")
 when 7 then date_format(published_at, "yyyy-MM-dd") else concat('about ', cast(published_at as string)) end"""
query("parse_dates", """select item_id, case when item_id%9=8 then null when item_id%9=7 then date_trunc('day', published_at)
 else published_at end as parsed from items_v""", "items")(
    lambda t: t.items.select("item_id", F.expr(_DATE_FORMS).alias("d"))
    .select("item_id", dates.parse_date(F.col("d")).alias("parsed")))

_AT = "cast(ts as timestamp)"
_SEC = f"((epoch_us({NOW_TS})-epoch_us({_AT}))/1000000.0)"
_I = lambda e: f"cast(cast({e} as bigint) as varchar)"
_MIN = f"floor((epoch_us({NOW_TS})-epoch_us({_AT}))/60000000.0+0.5)"
query("relative_dates", f"""select event_id, case when m<1 then 'now' when m<60 then {_I('m')}||'m' when h<24 then {_I('h')}||'h'
 when floor(h/24.0+0.5)<7 then {_I('floor(h/24.0+0.5)')}||'d' else strftime(ts,'%-d %b') end as shown,
 upper(strftime(ts,'%-d %b %Y')) as masthead
from (select *, floor(m/60.0+0.5) as h from (select *, {_MIN} as m from events))""")(
    lambda t: t.events.select("event_id", dates.relative_date(F.col("ts").cast("timestamp"), now()).alias("shown"),
                              dates.masthead_date(F.col("ts").cast("timestamp")).alias("masthead")))
query("poll_clock", f"""select event_id, case when s<60 then {_I('greatest(0,floor(s+0.5))')}||'s'
 when s<3600 then {_I('floor(s/60)')}||'m' when s<21600 then {_I('floor(s/3600)')}||'h '||{_I('floor(s/60)%60')}||'m'
 when s<86400 then {_I('floor(s/3600)')}||'h' else {_I('floor(s/86400)')}||'d' end as ago, next_in,
 (next_in//60)||':'||lpad(cast(next_in%60 as varchar),2,'0') as next_shown
from (select event_id, {_SEC} as s, cast(floor(case when l<5000 then l+1200000 else l end/1000.0+0.5) as bigint) as next_in
 from (select *, cast(ceil((epoch_us(ts)//1000)/1200000.0) as bigint)*1200000-epoch_us(ts)//1000 as l from events))""")(
    lambda t: t.events.withColumn("ts", F.col("ts").cast("timestamp")).select(
        "event_id", dates.ago((F.unix_micros(now()) - F.unix_micros("ts")) / 1_000_000).alias("ago"),
        dates.seconds_to_next_poll(F.col("ts")).alias("next_in"))
    .withColumn("next_shown", dates.countdown(F.col("next_in"))))
query("durations", """select event_id, case when event_id%5=4 then 0 else s end as seconds
from (select event_id, cast(floor(value) as bigint)*7 as s from events)""")(
    lambda t: t.events.select("event_id", (F.floor("value") * 7).alias("s")).select("event_id", dates.duration_seconds(F.expr(
        """case event_id%5 when 0 then concat('PT', s, 'S') when 1 then concat('PT', s div 60, 'M', s % 60, 'S')
        when 2 then concat('PT', s div 3600, 'H', s % 3600 div 60, 'M', s % 60, 'S')
        when 3 then concat('PT', s div 60, 'M', if(s % 60 = 0, '', concat(s % 60, 'S'))) else concat('P1DT', s, 'S') end"""))
        .alias("seconds")))

# --- search

query("fts_query_tokens", r"""select item_id, array_to_string(list_transform(
 regexp_extract_all(lower(title),'[\p{L}\p{N}]+')[1:12], lambda w: '"'||w||'"'),' ') as match from items_v""", "items")(
    lambda t: t.items.select("item_id", search.query_tokens(F.col("title")).alias("match")))

_TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce({0},''))),'[\p{{L}}\p{{N}}]+')"
_POST = " union all ".join(f"select item_id, '{c}' as col, unnest({_TOKENS.format(c)}) as term from items_v"
                           for c in search.TEXT_COLUMNS)
_SIZES = "select item_id, " + "+".join(f"len({_TOKENS.format(c)})" for c in search.TEXT_COLUMNS) + " as dl from items_v"
Q1, Q2 = "the", "por que"
query("postings", f"select term, item_id, col, count(*) as tf from ({_POST}) group by 1,2,3", "items")(
    lambda t: search.postings(t.text_items))


def _bm25_sql(terms: list[str], scope: str = "true") -> str:
    listed = ",".join(f"'{x}'" for x in terms)
    return f"""with p as (select term, item_id, count(*) as tf from ({_POST}) where term in ({listed}) group by 1,2),
s as ({_SIZES}), n as (select count(*) as n, avg(dl) as avgdl from s),
d as (select term, greatest(ln(((select n from n)-count(*)+0.5)/(count(*)+0.5)),1e-6) as idf from p group by 1),
r as (select p.item_id, sum(idf*tf*2.2/(tf+1.2*(0.25+0.75*dl/(select avgdl from n)))) as score
 from p join d on d.term=p.term join s on s.item_id=p.item_id group by 1 having count(*)={len(terms)})
select r.item_id, i.feed_id, i.title, f.title as feed_title, round(score,6) as score from r join items_v i
 on i.item_id=r.item_id join feeds_v f on f.feed_id=i.feed_id where {scope} order by score desc, r.item_id desc limit 100"""


def _found(t: Tables, q: str, **scope) -> DataFrame:
    index = search.build_index(t.text_items, stemmed=False)
    return search.search(t.items, t.feeds, q, index, stemmed=False, **scope).select(
        "item_id", "feed_id", "title", "feed_title", F.round("score", 6).alias("score"))


query("search", _bm25_sql(["de", "la"], "f.folder='News'"), "items feeds")(lambda t: _found(t, "De LA!", folder="News"))
query("search_bm25", _bm25_sql(["que"]), "items feeds")(lambda t: _found(t, "Qué"))
query("search_count", f"""select count(*) as n from (select item_id from ({_POST}) where term in ('de','la') group by 1
 having count(distinct term)=2)""", "items")(
    lambda t: search.search_count(t.items, t.feeds, "la de", search.build_index(t.text_items, stemmed=False),
                                  stemmed=False))


@query("search_common_term", _bm25_sql(["license", "the"]), "items feeds")
def _common_term(t: Tables) -> DataFrame:
    """A rare word beside one that most English items hold."""
    return _found(t, "the license")


# The words of one stem in these tables; the others stay as they are, which changes no document's length.
_STEMMED = "('license', 'licensed', 'licenses', 'licensing')"
_STEM_SQL = _bm25_sql(["licens"]).replace(f"({_POST})", f"(select item_id, case when term in {_STEMMED} then 'licens' else term end as term from ({_POST}))")


@query("search_stemmed", _STEM_SQL, "items feeds")
def _stemmed(t: Tables) -> DataFrame:
    return search.search(t.items, t.feeds, "Licenses", search.build_index(t.text_items)).select(
        "item_id", "feed_id", "title", "feed_title", F.round("score", 6).alias("score"))


@query("search_after_add", _bm25_sql(["que"]), "items feeds")
def _after_add(t: Tables) -> DataFrame:
    """A saved index that took the items in two steps, a third of them first with another text."""
    saved = search.SavedIndex(t.spark, f"{shared_dir(t.spark)}/feedloom/{uuid.uuid4().hex}", stemmed=False)
    items = stored(t.text_items)
    drafts = items.filter("item_id % 3 = 0").withColumn("content", F.concat(F.lit("que que "), "title"))
    saved.add(drafts.unionByName(items.filter("item_id % 3 = 1")), 1)
    saved.remove(drafts, 2)
    saved.add(items.filter("item_id % 3 <> 1"), 2)
    return search.search(t.items, t.feeds, "Qué", saved.open(), stemmed=False).select(
        "item_id", "feed_id", "title", "feed_title", F.round("score", 6).alias("score"))


@query("search_after_merge", _bm25_sql(["license", "the"]), "items feeds")
def _after_merge(t: Tables) -> DataFrame:
    """A saved index that took the items in six steps with merges of two parts, every third item first with another text."""
    saved = search.SavedIndex(t.spark, f"{shared_dir(t.spark)}/feedloom/{uuid.uuid4().hex}", stemmed=False, fan=2)
    items = stored(t.text_items)
    drafts = items.filter("item_id % 3 = 0").withColumn("content", F.concat(F.lit("the license of "), "title"))
    saved.add(drafts, 1)
    saved.add(items.filter("item_id % 3 = 1 and item_id % 2 = 0"), 2)
    saved.add(items.filter("item_id % 3 = 1 and item_id % 2 = 1"), 3)
    saved.remove(drafts, 4)
    saved.add(items.filter("item_id % 3 <> 1"), 4)
    return search.search(t.items, t.feeds, "the license", saved.open(), stemmed=False).select(
        "item_id", "feed_id", "title", "feed_title", F.round("score", 6).alias("score"))
