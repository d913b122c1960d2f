"""Subscription lists (OPML): flattened to feeds, and imported with added and skipped counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feedloom.functions.text import blank_to_null, decode_entities, js_trim, utf16_left
from feedloom.functions.urls import is_http
from feedloom.schemas import FEED_TITLE_CAP, FOLDER_CAP

_TAGS = r"""<outline\b(?:[^>"']++|"[^"]*"|'[^']*')*+>|</outline\s*>|</?body\b[^>]*>"""


def read_opml(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``doc_id`` (the file's path) and ``xml``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"),
                                                        F.col("value").alias("xml"))


def _attr(*names: str) -> Column:
    """The first of the named attributes that is there, as written; null where none is."""
    def one(name: str) -> Column:
        pattern = rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
        return F.when(F.col("tag").rlike(pattern), F.concat(F.regexp_extract("tag", pattern, 1),
                                                            F.regexp_extract("tag", pattern, 2)))

    return F.coalesce(*[one(n) for n in names])


def opml_feeds(files: DataFrame) -> DataFrame:
    """The feeds of each list in order: ``doc_id, pos, feed_url, title, site_url, folder``.

    A feed's folder is the label of the nearest outline around it that is no feed itself and has a label. Four running
    sums and lookups in file order settle that at any depth: how deep a tag lies, which outline a closing tag ends, how
    many labelled outlines are open, and which of those was opened last.
    """
    clean = F.regexp_replace("xml", r"<!--[\s\S]*?-->", "")
    # Only outlines inside the body count; a file without a body holds no feeds.
    tags = F.filter(F.regexp_extract_all(F.regexp_extract(clean, r"(?s)<body\b[^>]*>(.*)", 1), F.lit(_TAGS), F.lit(0)),
                    lambda t: ~t.rlike("^</?body"))
    # The outer explode keeps the tag search from running once more inside an inferred filter.
    rows = files.select("doc_id", F.posexplode_outer(tags).alias("pos", "tag")).filter("tag is not null")
    opens = ~F.col("tag").startswith("</")
    raw = {"feed_url": _attr("xmlUrl", "xmlurl"), "site_url": _attr("htmlUrl", "htmlurl"), "title": _attr("title", "text")}
    rows = rows.select("doc_id", "pos", opens.alias("opens"), (opens & ~F.col("tag").rlike(r"/\s*>$")).alias("nests"),
                       *[F.when(opens, v).alias(k) for k, v in raw.items()])
    clean_value = lambda c: blank_to_null(js_trim(decode_entities(F.col(c))))
    rows = rows.withColumns({"feed_url": clean_value("feed_url"), "site_url": clean_value("site_url"),
                             "title": F.coalesce(clean_value("title"), F.lit(""))})
    label = F.when(F.col("nests") & F.col("feed_url").isNull(), blank_to_null(F.col("title")))

    def before(*keys: str):
        return Window.partitionBy("doc_id", *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)

    def open_now(change):
        return F.coalesce(F.sum(change).over(before()), F.lit(0))

    closes = ~F.col("opens")
    rows = rows.withColumn("label", label).withColumn(
        "level", open_now(F.when(F.col("nests"), 1).when(closes, -1).otherwise(0)) - F.when(closes, 1).otherwise(0))
    ended = F.last(F.when(F.col("nests"), F.col("label").isNotNull()), ignorenulls=True).over(before("level"))
    rows = rows.withColumn("ends_label", closes & F.coalesce(ended, F.lit(False)))
    rows = rows.withColumn("around", open_now(F.when(F.col("label").isNotNull(), 1).when(F.col("ends_label"), -1).otherwise(0)))
    feed = ["feed_url", "title", "site_url"]
    none = [F.lit(None).cast("string").alias(c) for c in feed]
    labels = rows.filter("label is not null").select("doc_id", "pos", (F.col("around") + 1).alias("around"), "label", *none)
    held = rows.filter("feed_url is not null").select("doc_id", "pos", "around", F.lit(None).cast("string").alias("label"), *feed)
    folder = F.last("label", ignorenulls=True).over(before("around"))
    return labels.union(held).withColumn("folder", folder).filter("feed_url is not null").select("doc_id", "pos", *feed, "folder")


def to_add(listed: DataFrame, feeds: DataFrame) -> DataFrame:
    """Listed feeds with ``added``: http(s), not subscribed yet, first of its address."""
    usable = is_http(F.col("feed_url"))
    place = F.struct("doc_id", "pos")
    first = listed.filter(usable).groupBy("feed_url").agg(F.min(place).alias("_first"))
    new = first.join(feeds.select("feed_url"), "feed_url", "left_anti")
    return listed.join(new, "feed_url", "left").select(
        "doc_id", "pos", "feed_url", "site_url", utf16_left(F.col("title"), FEED_TITLE_CAP).alias("title"),
        blank_to_null(utf16_left(F.trim(F.coalesce("folder", F.lit(""))), FOLDER_CAP)).alias("folder"),
        F.coalesce(place == F.col("_first"), F.lit(False)).alias("added"))


def import_summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy("doc_id").agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("skipped"))
