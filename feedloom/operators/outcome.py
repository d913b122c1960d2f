"""What a landed response means for its feed: ok, not modified, or which error."""
from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from feedloom.functions.text import WS
from feedloom.schemas import NO_RULE_ERROR


def looks_like_feed(body: Column, content_type: Column) -> Column:
    text = F.regexp_replace(body, f"^\\uFEFF?[{WS}]*", "")
    return (
        (content_type.contains("json") & text.startswith("{"))
        | text.rlike(r"(?i)^(?:<\?xml|<rss\b|<feed\b|<rdf:RDF\b)")
        | content_type.rlike(r"(?i)application/(rss|atom|feed)\+|(^|/)xml")
    )


def is_html(body: Column, content_type: Column) -> Column:
    return content_type.rlike("(?i)html") | body.rlike(f"(?i)^[{WS}]*<(!doctype|html)")


def _typed(prefix: str) -> Column:
    kind = F.when(F.col("content_type") == "", "no content-type").otherwise(F.col("content_type"))
    return F.concat(F.lit(prefix + " (HTTP "), F.col("status").cast("string"), F.lit(", "), kind, F.lit(")"))


def _first_error(*cases: tuple[Column, Column]) -> Column:
    out = F
    for condition, message in cases:
        out = out.when(condition, message)
    return out


def _result(fetches: DataFrame, error: Column) -> DataFrame:
    """Status and error; a rejected response keeps no validators, a 304 keeps the ones that were sent."""
    status = (F.when(F.col("network_error").isNull() & (F.col("status") == 304), "not-modified")
              .when(F.col("error").isNotNull(), "error").otherwise("ok"))
    keep = lambda got, sent: (F.when(F.col("outcome") == "ok", F.col(got))
                              .when(F.col("outcome") == "not-modified", F.col(sent)).alias(got))
    sent = {c: c if c in fetches.columns else None for c in ("sent_etag", "sent_last_modified")}
    marked = fetches.withColumn("error", error).withColumn("outcome", status)
    for missing in (c for c, present in sent.items() if present is None):
        marked = marked.withColumn(missing, F.lit(None).cast("string"))
    others = [c for c in fetches.columns if c not in ("status", "etag", "last_modified", "sent_etag",
                                                      "sent_last_modified", "network_error", "error")]
    return marked.select(*others, F.col("outcome").alias("status"), "error",
                         keep("etag", "sent_etag"), keep("last_modified", "sent_last_modified"))


def _transport() -> list[tuple[Column, Column]]:
    return [
        (F.col("network_error").isNotNull(), F.concat(F.lit("Network error: "), F.col("network_error"))),
        (F.col("status") == 304, F.lit(None).cast("string")),
        (~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string"))),
    ]


def _with_defaults(fetches: DataFrame) -> DataFrame:
    return fetches.withColumn("content_type", F.coalesce("content_type", F.lit(""))).withColumn(
        "body", F.coalesce("body", F.lit("")))


def classify_feed(fetches: DataFrame, parse_error: Column | None = None) -> DataFrame:
    """``fetches`` with text bodies; ``parse_error`` is the parser's message where it gave up."""
    cases = _transport() + [(~looks_like_feed(F.col("body"), F.col("content_type")), _typed("Response was not a feed"))]
    if parse_error is not None:
        cases.append((parse_error.isNotNull(), F.concat(F.lit("Parse error: "), parse_error)))
    return _result(_with_defaults(fetches), _first_error(*cases))


def oversize(announced: Column, actual: Column, max_bytes: int | None) -> Column:
    """The refusal text for a page over the size limit, else null."""
    if max_bytes is None:
        return F.lit(None).cast("string")
    mb = lambda n: F.floor(n / 1e6 + 0.5).cast("string")
    limit = F.lit(f"MB, over the {max_bytes // 1_000_000}MB scrape limit")
    return (F.when(announced > max_bytes, F.concat(F.lit("page announces "), mb(announced), limit))
            .when(actual > max_bytes, F.concat(F.lit("page is "), mb(actual), limit)))


def classify_scrape(fetches: DataFrame, items: Column, item_selector: Column,
                    extractor_error: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """``items`` is what the rule extracted; a null ``item_selector`` is a feed without a usable rule."""
    too_big = oversize(F.col("content_length"), F.octet_length("body"), max_bytes)
    cases = [(item_selector.isNull(), F.lit(NO_RULE_ERROR))] + _transport() + [
        (too_big.isNotNull(), F.concat(F.lit("Could not read the page: Error: "), too_big)),
        (~is_html(F.col("body"), F.col("content_type")), _typed("Response was not an HTML page")),
    ]
    if extractor_error is not None:
        cases.append((extractor_error.isNotNull(),
                      F.concat(F.lit("The extractor failed on that page: "), extractor_error)))
    cases.append((F.coalesce(items, F.lit(0)) == 0,
                  F.concat(F.lit("The scrape rule matched nothing on that page (item selector: "), item_selector,
                           F.lit(")"))))
    return _result(_with_defaults(fetches), _first_error(*cases))


def decode_bodies(fetches: DataFrame, meta_chars: int | None = None) -> DataFrame:
    """Binary bodies to text by the declared charset: header first, then the page's own meta tag, else UTF-8.

    UTF-8 bodies stay in the JVM; only bodies with another label go to Python. Unknown labels read as UTF-8. Bad bytes become U+FFFD.
    With ``meta_chars`` the tag is looked for in that many characters only.
    """
    utf8 = F.make_valid_utf8(F.col("body").cast("string"))
    label = r"""charset=["']?([\w-]+)"""
    declared = F.regexp_extract(F.coalesce("content_type", F.lit("")), "(?i)" + label, 1)
    meta = F.regexp_extract(utf8 if meta_chars is None else F.left(utf8, F.lit(meta_chars)), r"(?i)<meta[^>]+" + label, 1)
    charset = F.lower(F.when(declared != "", declared).otherwise(meta))
    legacy = F.when((charset != "") & ~charset.isin("utf-8", "utf8"), F.col("body"))
    decoded = F.coalesce(decode_udf(legacy, charset), utf8)
    return fetches.withColumn("charset", charset).withColumn("body", F.regexp_replace(decoded, "^\ufeff", ""))


# Codecs that the web reads as a wider one.
_WIDER = {"iso8859-1": "cp1252", "ascii": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "tis-620": "cp874",
          "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "euc_kr": "cp949", "johab": "cp949", "big5": "big5hkscs",
          "utf-16": "utf-16-le"}
# Web labels that Python's codec registry does not know.
_LABELS = {"dos-874": "cp874", "x-mac-cyrillic": "mac-cyrillic", "x-mac-roman": "mac-roman", "macintosh": "mac-roman",
           "mac": "mac-roman", "ks_c_5601-1987": "cp949", "ks_c_5601-1989": "cp949", "windows-949": "cp949", "korean": "cp949",
           "windows-31j": "cp932", "ms_kanji": "cp932", "x-sjis": "cp932", "sjis": "cp932", "koi": "koi8-r", "koi8": "koi8-r",
           "koi8-ru": "koi8-u", "iso-8859-8-i": "iso8859-8", "logical": "iso8859-8", "visual": "iso8859-8", "big5-hkscs": "big5hkscs",
           "cn-big5": "big5hkscs", "x-x-big5": "big5hkscs", "x-gbk": "gb18030", "chinese": "gb18030", "ucs-2": "utf-16-le",
           "unicode": "utf-16-le", "csunicode": "utf-16-le", "unicodefffe": "utf-16-be", "unicodefeff": "utf-16-le",
           "x-euc-jp": "euc_jp"}


def codec_of(label: str) -> str | None:
    """The codec that reads a web charset label; None where there is none."""
    for name in (_LABELS.get(label), label, label.removeprefix("x-")):
        try:
            found = name and codecs.lookup(name)
        except LookupError:
            continue
        if found and found._is_text_encoding:
            return _WIDER.get(found.name, found.name)
    return None


def decode_body(body: bytes, label: str) -> str | None:
    """Bytes to text by a label; a byte order mark beats the label. Bytes that a Windows code page leaves open are control
    characters, other bad bytes U+FFFD."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark):].decode(name, "replace")
    codec = codec_of(label)
    if codec is None:
        return None
    if codec.startswith("cp125") or codec == "cp874":
        return "".join(part.decode(codec, "replace") if part[0] not in range(0x80, 0xA0) or part.decode(codec, "ignore")
                       else part.decode("latin-1") for part in re.findall(rb"[\x80-\x9f]|[^\x80-\x9f]+", body))
    return body.decode(codec, "replace")


@pandas_udf(StringType())
def decode_udf(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode_body(b, c) for b, c in zip(body, charset)], dtype=object)
