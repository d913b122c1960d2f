"""URL columns: http(s) test, video and channel ids, link resolution."""
from __future__ import annotations

import re
from ipaddress import IPv6Address
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from feedloom.functions.text import blank_to_null, decode_page_entities, js_trim, let
from feedloom.schemas import YOUTUBE_MARKER

_HTTP = "(?i)^https?://"

# Address forms that carry a video id, and where a channel page states its own id, best first.
_VIDEO = r"(?i)(?:youtube(?:-nocookie)?\.com/(?:watch\?(?:.*&)?v=|embed/|shorts/|v/)|youtu\.be/)([\w-]{11})"
_CHANNEL = [
    r'"externalId":"(UC[\w-]{20,})"',
    r'rel="canonical"[^>]*href="https://www\.youtube\.com/channel/(UC[\w-]{20,})"',
    r"/feeds/videos\.xml\?channel_id=(UC[\w-]{20,})",
    r'itemprop="(?:channelId|identifier)"\s+content="(UC[\w-]{20,})"',
    r'"channelId":"(UC[\w-]{20,})"',
]


def is_http(c: Column) -> Column:
    return F.coalesce(js_trim(c).rlike(_HTTP), F.lit(False))


def safe_url(c: Column) -> Column:
    return F.when(is_http(c), js_trim(c))


def video_id(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, _VIDEO, 1))


def is_video_feed(feed_url: Column) -> Column:
    return feed_url.contains(YOUTUBE_MARKER)


def channel_id_in_page(html: Column) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(html, p, 1)) for p in _CHANNEL])


def is_channel_url(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.|^m\.", "")
    return F.coalesce((host == "youtube.com") & ~is_video_feed(url), F.lit(False))


def channel_id_in_url(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, r"/channel/(UC[\w-]{20,})", 1))


def channel_feed(channel_id: Column) -> Column:
    return F.concat(F.lit(f"https://www.{YOUTUBE_MARKER}?channel_id="), channel_id)


def origin(url: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#\\]+)", 1)))


def _joined(base: str, text: str) -> str:
    """As ``urljoin``, which drops empty segments of paths it joins; here they stay."""
    if re.match(r"[^:/?#]+(?:[/?#]|$)", text):
        place = re.match(r"(?i)https?://[^/?#]*([^?#]*/)?", base)
        return (place[0] if place[1] else place[0] + "/") + text if place else urljoin(base, text)
    return base[:base.index("://") + 3] + re.match(r"[^/?#]*", base.split("://", 1)[1])[0] + text if (
        re.match(r"/(?!/)", text) and re.match(r"(?i)https?://", base)) else urljoin(base, text)


def _without_dots(path: str) -> str:
    kept: list[str] = []
    for part in path.split("/")[1:]:
        if part == "..":
            del kept[-1:]
        elif part != ".":
            kept.append(part)
    return "/" + "/".join(kept + [""] * path.endswith(("/.", "/..")))


def resolve(href: str | None, base: str | None) -> str | None:
    """``href`` against ``base``, spelt as a browser would spell it; null where either is no address."""
    if href is None or base is None:
        return None
    text = re.sub(r"[\t\r\n]", "", href.strip("".join(map(chr, range(33)))))
    scheme = re.match(r"(?i)([a-z][a-z0-9+.-]*):", text)
    if scheme and scheme[1].lower() not in ("http", "https"):
        return text
    cut = re.search(r"[?#]|$", text).start()
    text = text[:cut].replace("\\", "/") + text[cut:]
    if scheme:
        text = f"{scheme[1].lower()}://" + text[scheme.end():].lstrip("/")
    try:
        parts = urlsplit(_joined(base, text))
        host = (parts.hostname or "").encode("idna").decode() if not (parts.hostname or "").isascii() else parts.hostname
        if parts.scheme not in ("http", "https") or not host or re.search(r"[\s<>^|%\\]", host):
            return None
        if ":" in host:
            # An IPv6 host keeps its brackets and is spelt in its shortest form.
            host = f"[{IPv6Address(host).compressed}]"
        port = parts.port
    except (ValueError, UnicodeError):
        return None
    default = {"http": 80, "https": 443}[parts.scheme]
    login = parts.netloc.rpartition("@")[0]
    netloc = (login + "@" if login else "") + host + (f":{port}" if port not in (None, default) else "")
    return urlunsplit((
        parts.scheme, netloc,
        quote(_without_dots(parts.path or "/"), safe="/%:@!$&'()*+,;=~[]|^\\"),
        quote(parts.query, safe="/%:@!$&()*+,;=~[]|^\\?`{}"),
        quote(parts.fragment, safe="/%:@!$&'()*+,;=~[]|^\\?#{}"),
    ))


@pandas_udf(StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(h, b) for h, b in zip(href, base)], dtype=object)


# Marked so that a filter on the result does not run it a second time.
resolve_url_udf = resolve_url.asNondeterministic()


# Characters that stand for themselves in every part of an address, and hosts that need no respelling.
_PLAIN = r"A-Za-z0-9_.~%:@!$&()*+,;=/\-"
_REST = rf"(?:\?[{_PLAIN}?]+)?(?:#[{_PLAIN}?']+)?$"
_HOST = r"(?:[a-z0-9.-]+|\[::[1-9a-f][0-9a-f]{0,3}\])"
_ADDRESS = rf"^(https?://{_HOST})(/[{_PLAIN}']*)({_REST[:-1]})$"
_PLACE = rf"^(https?://{_HOST})([/?#].*)?$"
_PATH = rf"^[{_PLAIN}']*{_REST}"


def without_dots(path: Column) -> Column:
    """A path that opens with a slash without its ``.`` and ``..`` segments; empty segments stay."""
    parts = F.split(path, "/")
    walk = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), lambda kept, part: (
        F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))))
    # A path that ends in such a segment names a folder.
    kept = F.when(path.rlike(r"/\.\.?$"), F.concat(walk, F.array(F.lit("")))).otherwise(walk)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def plain_link(href: Column, base: Column) -> Column:
    """``href`` against ``base`` where no character needs respelling: an absolute address, or a host, path from the root,
    path from the page or query on a plain host. Null for all other links."""
    site = F.regexp_extract(base, _PLACE, 1)
    behind = F.regexp_extract(F.regexp_extract(base, _PLACE, 2), r"^[^?#]*", 0)
    path = F.when(behind == "", "/").otherwise(behind)
    usable = base.isNotNull() & (site != "")
    # A path whose first segment holds a colon would read as a scheme.
    full = (F.when(base.isNotNull() & href.rlike("^https?://"), href)
            .when(usable & href.startswith("//"), F.concat(F.regexp_extract(base, "^https?:", 0), href))
            .when(usable & href.startswith("?") & href.rlike(_PATH), F.concat(site, path, href))
            .when(usable & href.startswith("/") & href.rlike(_PATH), F.concat(site, href))
            .when(usable & href.rlike(_PATH) & href.rlike(r"^[^:/?#]+(?:[/?#]|$)"),
                  F.concat(site, F.regexp_extract(path, "^.*/", 0), href)))
    part = lambda c, n: F.regexp_extract(c, _ADDRESS, n)
    return let(full, lambda c: F.when(c.rlike(_ADDRESS), F.concat(part(c, 1), without_dots(part(c, 2)), part(c, 3))))


def with_absolute_link(df: DataFrame, href: Column, base: Column, out: str = "url") -> DataFrame:
    """Add a page link as an absolute http(s) address; null for fragments, scripts, mail and phone links."""
    raw = js_trim(decode_page_entities(href))
    usable = let(raw, lambda r: F.when(
        (r != "") & ~r.startswith("#") & ~r.rlike("(?i)^(javascript|mailto|tel):"), r))
    # Common links are put together in the JVM; Python sees only those that need respelling.
    split = df.withColumn("__href", usable).withColumn("__plain", plain_link(F.col("__href"), base))
    rest = resolve_url_udf(F.when(F.col("__plain").isNull(), F.col("__href")), F.when(F.col("__plain").isNull(), base))
    resolved = split.withColumn(out, F.coalesce(F.col("__plain"), rest)).drop("__href", "__plain")
    return resolved.withColumn(out, F.when(F.col(out).rlike("^https?:"), F.col(out)))
