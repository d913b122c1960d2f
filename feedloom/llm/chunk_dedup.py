"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (after a line or sentence end, once a chunk is long enough). Every distinct
chunk moves once, to the place that verifies its identifier: an identifier holds for one content only, and a hash shared
by several contents is split by variant. A document is then its ordered list of identifiers, and documents are equal
exactly when the lists are; long texts never meet each other.

Nulls count as empty texts. Rows that repeat a doc_id are rows of their own; of equal rows one stays. A null doc_id
orders before all others.

Empty tables give no rows, and other columns may have any name.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm.common import whole_text
from feedloom.session import stored

#: Chunk lengths in characters. A chunk ends at the first line or sentence end past the least length.
LEAST, MOST = 512, 8192
#: Groups are copied to this many slices of their rows, so that one group's rows are joined by many tasks.
SLICES = 32


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Content-defined chunks; joined together they are the text again. Where no boundary comes for ``most``
    characters, the chunk ends there; the rule sees only what lies in the chunk, so equal texts are cut alike."""
    pattern = rf"(?s).{{{least},{most}}}?(?:(?<=\n)|(?<=[.!?。！？]\s))|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def verified_variants(docs: DataFrame, text: Column, ident: Callable[[Column], Column]) -> DataFrame:
    """Contents whose identifier is shared with another content, each with its variant number: (hash, chunk, variant).

    Contents are made distinct on the map side first, so a chunk that a third of all documents hold moves once per task.
    """
    once = docs.select(F.explode(chunks(text)).alias("chunk")).groupBy(ident(F.col("chunk")).alias("hash"), "chunk").agg(
        F.count(F.lit(1)).alias("seen"))
    kept = stored(once.groupBy("hash").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1"))
    if kept.isEmpty():
        return docs.sparkSession.createDataFrame([], "hash bigint, chunk string, variant int")
    by_content = Window.partitionBy("hash").orderBy("chunk")
    return once.join(kept, "hash").select("hash", "chunk", (F.row_number().over(by_content) - 1).alias("variant"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            ident: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(row, id, recipe, variants, text_sha256): the verified recipe of every row.

    ``variants`` is empty unless a chunk's hash is shared by two contents; then it numbers the contents by position.
    """
    text = whole_text(text_col)
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.transform(chunks(text), lambda c: ident(c)).alias("recipe"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    shared = verified_variants(docs, text, ident)
    if shared.isEmpty():
        return stored(base.withColumn("variants", F.array().cast("array<int>")))
    # Lists of variants by text; they differ from empty only where a text holds a shared hash.
    cut = (docs.select(F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.posexplode(chunks(text)).alias("pos", "chunk"))
           .withColumn("hash", ident(F.col("chunk"))).join(shared, ["hash", "chunk"])
           .groupBy("text_sha256")
           .agg(F.array_sort(F.collect_set(F.struct("pos", "variant"))).alias("at"))
           .select("text_sha256", F.transform("at", lambda x: x["variant"]).alias("variants")))
    return stored(base.join(cut, "text_sha256", "left").withColumn(
        "variants", F.coalesce("variants", F.array().cast("array<int>"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays."""
    rows = recipes(docs, id_col, text_col, **how)
    groups = rows.groupBy("recipe", "variants").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "row")).alias("keep")).filter("size > 1")
    # A group may hold a third of all rows: its summary is copied to slices and the rows are spread over them.
    sliced = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    joined = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int")).join(
        sliced, ["recipe", "variants", "slice"], "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256")


def keep_first_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows equal in id and text are one row."""
    kept = stored(exact_dedup(docs, id_col, text_col).filter("kept").select(
        F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")))
    keyed = docs.withColumn("__sha", F.sha2(whole_text(text_col).cast("binary"), 256))
    rows = keyed.join(kept, keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__sha"] == kept["__sha"]), "left_semi")
    same = kept.join(exact_repeats(docs, id_col, text_col), ["__id", "__sha"], "left_semi")
    return rows.drop("__sha") if same.isEmpty() else rows.dropDuplicates([id_col, "__sha"]).drop("__sha")


def exact_repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __sha) of rows that stand in the table more than once with the same id and text."""
    return docs.groupBy(F.col(id_col).alias("__id"), F.sha2(whole_text(text_col).cast("binary"), 256).alias("__sha")).count().filter(
        "count > 1").drop("count")
