"""Finding a site's feed in a landed crawl: channel pages, the address itself, declared links, usual paths."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from feedloom.functions import urls
from feedloom.functions.text import decode_href, let
from feedloom.functions.urls import resolve
from feedloom.operators.outcome import looks_like_feed
from feedloom.operators.parse import parse_feeds
from feedloom.schemas import COMMON_PATHS, FEED_TYPES


_ATTRIBUTE = r"""([A-Za-z][\w:-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_QUOTES = r"""^["']|["']$"""


@pandas_udf(StringType())
def _first_resolved(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    found = (next((u for h in (hs if hs is not None else ()) if (u := resolve(h, b))), None)
             for hs, b in zip(hrefs, base))
    return pd.Series(list(found), dtype=object)


first_resolved_udf = _first_resolved.asNondeterministic()


def with_feed_link(pages: DataFrame, html: str = "html", base: str = "url", out: str = "feed_url",
                   head_chars: int | None = None) -> DataFrame:
    """Add the feed a page declares: the first alternate link of a feed type whose address resolves, in the whole page or
    in its first ``head_chars`` characters.

    The tag list stays an array inside its row, so pages are not exploded or shuffled.
    """
    # A tag's attributes as (name, value), quoted or not; the first of a name counts.
    read = lambda tag: F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.struct(
        F.lower(F.regexp_extract(a, _ATTRIBUTE, 1)).alias("name"), F.trim(F.regexp_replace(F.regexp_extract(a, _ATTRIBUTE, 2), _QUOTES, "")).alias("value")))
    value = lambda attrs, name: F.coalesce(F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"], F.lit(""))
    tags = F.regexp_extract_all(html if head_chars is None else F.left(html, F.lit(head_chars)), F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    links = F.transform(tags, lambda t: let(read(t), lambda attrs: F.struct(
        *[value(attrs, name).alias(name) for name in ("rel", "type", "href")])))
    declared = F.filter(links, lambda k: F.array_contains(F.split(F.lower(k["rel"]), r"\s+"), "alternate")
                        & F.lower(k["type"]).isin(FEED_TYPES) & (k["href"] != ""))
    hrefs = F.transform(declared, lambda k: decode_href(k["href"]))
    return pages.withColumn(out, first_resolved_udf(F.when(F.size(hrefs) > 0, hrefs), F.col(base)))


def answered(crawl: DataFrame) -> DataFrame:
    return crawl.filter(F.col("status").between(200, 299))


def _is_feed() -> Column:
    return looks_like_feed(F.coalesce("body", F.lit("")), F.coalesce("content_type", F.lit("")))


def feed_candidates(sites: DataFrame, crawl: DataFrame) -> DataFrame:
    """Per origin the first usual path at which the crawl holds a feed. ``sites`` has ``url``."""
    paths = F.array(*[F.lit(p) for p in COMMON_PATHS])
    guesses = sites.select(urls.origin(F.col("url")).alias("origin")).filter("origin is not null").distinct().select(
        "origin", F.posexplode(paths).alias("pos", "path"))
    feeds = answered(crawl).filter(_is_feed()).select(
        F.col("url").alias("guess"), F.coalesce("final_url", "url").alias("feed_url")).dropDuplicates(["guess"])
    hits = guesses.withColumn("guess", F.concat("origin", "path")).join(feeds, "guess")
    return hits.groupBy("origin").agg(F.min("pos").alias("pos"), F.min_by("feed_url", "pos").alias("feed_url"))


def discover_feeds(sites: DataFrame, crawl: DataFrame, head_chars: int | None = None) -> DataFrame:
    """What each requested address resolves to: ``site_id, url, how, feed_url, title, site_url, error``.

    In order: a video channel's feed, the address itself, the feed its page declares, a usual path. ``crawl`` holds one
    response per address (``url, final_url, status, content_type, body``). Every step is an equi-join on addresses; feed
    bodies are parsed once, for their titles. With ``head_chars`` a page's declared feed is looked for in so many characters only.
    """
    good = answered(crawl).withColumn("is_feed", _is_feed())
    final = F.coalesce("final_url", "url")
    read = parse_feeds(good.select("url", final.alias("landed"), "content_type",
                                   F.when(F.col("is_feed"), F.col("body")).alias("body"))).select(
        "url", "landed", "feed_title", F.col("site_url").alias("states_site"))

    def lookup(prefix: str) -> DataFrame:
        return read.select(*[F.col(c).alias(f"{prefix}_{c}") for c in read.columns])

    # What a page says is read where it is scanned: no body takes part in a join.
    pages = crawl.select("url", "status", "body", "content_type", final.alias("landed")).withColumn(
        "ok", F.coalesce(F.col("status").between(200, 299), F.lit(False)))
    pages = pages.withColumns({"is_feed": F.col("ok") & _is_feed(), "channel_in_page": F.when(
        F.col("ok") & urls.is_channel_url(F.col("url")), urls.channel_id_in_page(F.col("body")))})
    pages = with_feed_link(pages.withColumn("page", F.when(F.col("ok") & ~F.col("is_feed"), F.col("body"))),
                           "page", "landed", "linked", head_chars).drop("body", "page", "content_type")
    asked = sites.select("site_id", "url").join(pages, "url", "left").fillna(False, ["ok", "is_feed"])
    channel = F.when(urls.is_channel_url(F.col("url")),
                     F.coalesce(urls.channel_id_in_url(F.col("url")), F.col("channel_in_page")))
    asked = asked.withColumns({"channel_feed": urls.channel_feed(channel), "origin": urls.origin(F.coalesce("landed", "url"))})
    guesses = feed_candidates(asked.filter("ok").select(F.col("landed").alias("url")), crawl).select(
        "origin", F.col("feed_url").alias("guessed"))
    found = asked.join(guesses, "origin", "left")
    how = (F.when(F.col("channel_feed").isNotNull(), "channel").when(~F.col("ok"), "error")
           .when(F.col("is_feed"), "itself").when(F.col("linked").isNotNull(), "linked")
           .when(F.col("guessed").isNotNull(), "guessed").otherwise("none"))
    target = (F.when(F.col("how") == "channel", F.col("channel_feed")).when(F.col("how") == "itself", F.col("url"))
              .when(F.col("how") == "linked", F.col("linked")).when(F.col("how") == "guessed", F.col("guessed")))
    found = found.withColumn("how", how).withColumn("target", target)
    titled = found.join(lookup("t"), found["target"] == F.col("t_url"), "left")
    feed_url = F.when(F.col("how").isin("itself", "linked"), F.coalesce("t_landed", "target")).otherwise(F.col("target"))
    states_site = F.when(F.col("how").isin("channel", "linked"), F.coalesce("t_states_site", "url")).otherwise(
        F.col("t_states_site"))
    reason = F.when(F.col("how") == "error", F.concat(
        F.lit("Could not fetch "), "url", F.lit(" (HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none")),
        F.lit(").")))
    return titled.select(
        "site_id", "url", "how", feed_url.alias("feed_url"),
        F.when(F.col("target").isNotNull(), F.coalesce("t_feed_title", F.lit(""))).alias("title"),
        F.when(F.col("target").isNotNull(), states_site).alias("site_url"),
        F.when(F.col("how") == "none", "No RSS, Atom or JSON feed was found at that address.").otherwise(reason).alias("error"))
