"""Full-text search over title, summary and content: postings, AND match, BM25 rank."""
from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.functions.porter import porter_stem_udf, stem
from feedloom.operators.joins import join_checked
from feedloom.operators.lists import View, in_scope, list_items, with_feed
from feedloom.schemas import PAGE_SIZE, QUERY_CAP, QUERY_TOKENS
from feedloom.session import remove, scratch, stored
from feedloom.sources.tables import Table

TEXT_COLUMNS = ("title", "summary", "content")
# BM25 parameters and the floor of a term's weight.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Hits that a search sends to every task; three numbers each.
JOIN_ROWS = 1_000_000


def _base(ch: str) -> str:
    """A letter without its marks."""
    return unicodedata.normalize("NFD", ch)[0]


# Accented Latin letters and what they fold to, derived from Unicode.
_LATIN = [chr(cp) for block in ((0xC0, 0x250), (0x1E00, 0x1F00)) for cp in range(*block)]
_ACCENTED = [ch for ch in _LATIN if ch.lower() == ch and _base(ch) != ch and _base(ch).isascii()]
_FROM, _TO = "".join(_ACCENTED), "".join(map(_base, _ACCENTED))


def fold(c: Column) -> Column:
    """Lower case, Latin accents off."""
    return F.translate(F.regexp_replace(F.lower(c), r"[̀-ͯ]", ""), _FROM, _TO)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def query_tokens(q: Column) -> Column:
    """The terms of a query: runs of letters and digits, the first twelve, each quoted."""
    words = F.slice(F.regexp_extract_all(F.lower(q), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, QUERY_TOKENS)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def query_terms(spark: SparkSession, q: str, stemmed: bool = True) -> list[str]:
    """A query's terms, cut and folded by the same column as the texts and stemmed as the index is; empty means the plain
    list is asked for."""
    words = spark.range(1).select(tokens(F.lit(q.strip()[:QUERY_CAP])).alias("w")).first()["w"][:QUERY_TOKENS]
    return [stem(w) if stemmed else w for w in words]


# The outer explode keeps the optimizer from adding a non-empty filter below it, which would tokenize every text again.

def postings(items: DataFrame) -> DataFrame:
    """``term, item_id, col, tf``. A row's tokens are counted before they leave its task, so the shuffle carries distinct
    (item, column, term) only."""
    by_column = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("terms")) for c in TEXT_COLUMNS])
    return (items.select("item_id", F.explode(by_column).alias("t"))
            .select("item_id", F.col("t.col").alias("col"), F.explode_outer("t.terms").alias("term"))
            .filter("term is not null").groupBy("term", "item_id", "col").agg(F.count(F.lit(1)).alias("tf")))


def by_stem(counts: DataFrame, *keys: str) -> DataFrame:
    """Term counts added up by stem. Only the distinct terms go through Python."""
    stems = counts.select("term").distinct().withColumn("stem", porter_stem_udf(F.col("term")))
    return (join_checked(counts, stems, "term", "inner").groupBy(*keys, F.col("stem").alias("term"))
            .agg(F.sum("tf").alias("tf")))


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """Stored postings (``bucket, term, item_id, tf, dl``) and the two totals a rank needs.

    A saved index has several parts: there removed rows count below zero until a merge drops them, and ``terms``
    (``bucket, term, df``) adds up to the number of items of each term.
    """
    postings: DataFrame
    n: int
    avgdl: float
    buckets: int
    terms: DataFrame | None = None

    def _held(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of some terms: only the folders of their buckets are read."""
        asked = [F.lit(t) for t in terms]
        folders = [term_bucket(t, self.buckets) for t in asked]
        return rows.filter(F.col("bucket").isin(*folders) & F.col("term").isin(*asked))

    def of(self, terms: list[str], lo: int | None = None, hi: int | None = None) -> DataFrame:
        """The postings of some terms, of the items from ``lo`` to ``hi`` where that is given."""
        rows = self._held(self.postings, terms)
        rows = rows if lo is None else rows.filter(F.col("item_id").between(lo, hi))
        if self.terms is None:
            return rows
        return rows.groupBy("term", "item_id").agg(F.sum("tf").alias("tf"), F.sum("dl").alias("dl")).filter("tf > 0")

    def counts(self, terms: list[str]) -> dict[str, int]:
        """How many items hold each term; a number per term of the query goes to the driver."""
        if self.terms is None:
            rows = self.of(terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        else:
            rows = self._held(self.terms, terms).groupBy("term").agg(F.sum("df").alias("df"))
        return {t: 0 for t in terms} | {r["term"]: r["df"] for r in rows.collect()}


def item_terms(items: DataFrame, stemmed: bool) -> DataFrame:
    """``item_id, dl, term, tf``: the terms of all columns together, with the item's length beside them."""
    words = F.concat(*[tokens(F.col(c)) for c in TEXT_COLUMNS])
    counts = (items.select("item_id", words.alias("w"))
              .select("item_id", F.size("w").cast("bigint").alias("dl"), F.explode_outer("w").alias("term"))
              .filter("term is not null").groupBy("item_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    return by_stem(stored(counts), "item_id", "dl") if stemmed else counts


def build_index(items: DataFrame, stemmed: bool = True, buckets: int = 64) -> Index:
    """Postings of all columns together, with each item's length beside its terms, stored in folders by term.

    An item's tokens and their number come from its own row, so one shuffle of (item, term) counts builds the index, and
    a search reads its terms' folders and joins nothing. Folders are rebalanced: a term that every item holds is many
    files and a rare one few.
    """
    counts = item_terms(items, stemmed)
    placed = counts.withColumn("bucket", term_bucket(F.col("term"), buckets)).hint("rebalance", "bucket")
    index = stored(placed.sortWithinPartitions("bucket", "term", "item_id"), "bucket")
    n, held = items.count(), index.agg(F.sum("tf")).first()[0] or 0
    return Index(index, n, held / n if held else 1.0, buckets)


class SavedIndex:
    """An index that lives on in a folder: items are added and removed in numbered steps, and a search reads the folders of
    its terms without a rebuild.

    Every step is a part. A removal names the rows as they were indexed and writes their postings below zero, into the folders of their terms, so
    a search adds up what it reads anyway and needs no list of removals. An update is the removal of the old rows and the
    addition of the new ones in one step. As soon as ``fan`` parts have one size, they are merged into a part of the
    next: sums of nothing are dropped, and each term's items lie in order. So a search over any number of steps
    opens at most ``fan`` - 1 parts of each size, and a posting is rewritten once for each size.

    The list of parts, a few rows, is written last and makes the step count; what broke off before is not seen, and is written
    over when the step is repeated. A step that counts already is left alone. Parts that were merged go one step later, so that a
    search that began before the merge can end.
    """

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True, buckets: int = 64, fan: int = 4):
        if fan < 2:
            raise ValueError("a merge takes two parts at least")
        self.spark, self.path, self.stemmed, self.buckets, self.fan = spark, path, stemmed, buckets, fan
        self.postings = Table(spark, f"{path}/postings", "term string, item_id bigint, tf bigint, dl bigint", "term", buckets)
        self.terms = Table(spark, f"{path}/terms", "term string, df bigint", "term", buckets)
        self.parts = Table(spark, f"{path}/parts", "name string, level int, n bigint, held bigint, step int, gone boolean")

    def _listed(self) -> tuple[int, list]:
        """The newest list's number, and its rows."""
        rows = self.parts.rows()
        newest = rows.agg(F.max("batch")).first()[0]
        return (0, []) if newest is None else (int(newest[1:]), rows.filter(F.col("batch") == newest).drop("bucket", "batch").collect())

    def live(self) -> list:
        """The parts that a search opens now."""
        return [r for r in self._listed()[1] if not r["gone"]]

    def _put(self, name: str, rows: DataFrame, terms: DataFrame) -> None:
        self.postings.put(rows, name, "term", "item_id")
        self.terms.put(terms, name, "term")

    def _merged(self, group: list, name: str) -> tuple:
        of = lambda table: table.rows().filter(F.col("batch").isin([r["name"] for r in group]))
        rows = of(self.postings).groupBy("term", "item_id").agg(F.sum("tf").alias("tf"), F.sum("dl").alias("dl")).filter("tf <> 0 or dl <> 0")
        self._put(name, rows, of(self.terms).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"))
        return name, group[0]["level"] + 1, sum(r["n"] for r in group), sum(r["held"] for r in group), max(r["step"] for r in group), False

    def _write(self, items: DataFrame, step: int, sign: int) -> None:
        number, listed = self._listed()
        kind = "add" if sign > 0 else "remove"
        name = f"{kind}-{step}"
        newest = max((r["step"] for r in listed), default=-1)
        if step < newest or any(r["name"] == f"took-{name}" for r in listed):
            return
        with scratch(self.spark):
            rows = stored(item_terms(items, self.stemmed).select("term", "item_id", (sign * F.col("tf")).alias("tf"), (sign * F.col("dl")).alias("dl")))
            self._put(name, rows, rows.groupBy("term").agg(F.sum(F.lit(sign)).cast("bigint").alias("df")))
            # Terms are counted in what is written, so that the texts are read and cut into terms once.
            held = rows.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        n = items.count()
        fields = self.parts.columns
        parts = [r.asDict() for r in listed if not r["gone"]] + [dict(zip(fields, (name, 0, sign * n, held, step, False)))]
        gone, level = [], 0
        while len(group := [p for p in parts if p["level"] == level]) >= self.fan:
            done = dict(zip(fields, self._merged(group, f"merge-{level + 1}-{number + 1}")))
            parts = [p for p in parts if p["level"] != level] + [done]
            gone, level = gone + group, level + 1
        # What the newest step took already is told by marks, which hold nothing.
        marks = [f"took-{name}"] + [r["name"] for r in listed if r["name"].startswith("took-") and r["step"] == step]
        rows = [(*[p[f] for f in fields[:-1]], False) for p in parts] + [(*[p[f] for f in fields[:-1]], True) for p in gone]
        rows += [(m, -1, 0, 0, step, True) for m in marks]
        self.parts.put(self.spark.createDataFrame(rows, self.parts.schema), f"v{number + 1:018d}")
        for r in listed:
            if r["gone"] and r["level"] >= 0:
                for table in (self.postings, self.terms):
                    for bucket in range(self.buckets):
                        remove(self.spark, f"{table.path}/bucket={bucket}/batch={r['name']}")

    def add(self, items: DataFrame, step: int) -> None:
        self._write(items, step, 1)

    def remove(self, items: DataFrame, step: int) -> None:
        self._write(items, step, -1)

    def open(self) -> Index:
        """The index as it stands; the list of parts goes to the driver."""
        parts = self.live()
        names = [r["name"] for r in parts]
        n, held = sum(r["n"] for r in parts), sum(r["held"] for r in parts)
        of = lambda table: table.rows().filter(F.col("batch").isin(names) if names else F.lit(False)).drop("batch")
        return Index(of(self.postings), n, held / n if n and held else 1.0, self.buckets, of(self.terms))


def match(index: Index, terms: list[str], counts: dict[str, int] | None = None) -> DataFrame:
    """Items that hold every term in any column: ``item_id, dl`` and a count ``tf_i`` per distinct term.

    The rarest term leads. The other terms' postings are read between its first and last item only, rarest first, and meet the
    hits so far in a join; these are broadcast while the rarest term has at most ``JOIN_ROWS`` items, so that a common term's postings
    never move.
    """
    distinct = sorted(set(terms))
    counts = index.counts(distinct) if counts is None else counts
    order = sorted(range(len(distinct)), key=lambda i: counts[distinct[i]])
    named = lambda i, **span: index.of([distinct[i]], **span).select("item_id", *([] if span else ["dl"]), F.col("tf").alias(f"tf_{i}"))
    hits = named(order[0])
    if len(order) > 1:
        lo, hi = hits.agg(F.min("item_id"), F.max("item_id")).first()
        for i in order[1:]:
            held = F.broadcast(hits) if counts[distinct[order[0]]] <= JOIN_ROWS else hits
            hits = named(i, lo=0 if lo is None else lo, hi=-1 if hi is None else hi).join(held, "item_id")
    return hits.select("item_id", "dl", *[f"tf_{i}" for i in range(len(distinct))])


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """``item_id, score`` for every match, higher is better. A term asked for twice weighs twice."""
    weights = Counter(terms)
    distinct = sorted(weights)
    counts = index.counts(distinct)
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl))
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        idf = max(math.log((index.n - counts[t] + 0.5) / (counts[t] + 0.5)), IDF_FLOOR)
        score = score + weights[t] * idf * F.col(f"tf_{i}") * (K1 + 1) / (F.col(f"tf_{i}") + norm)
    return match(index, terms, counts).select("item_id", score.alias("score"))


def search(items: DataFrame, feeds: DataFrame, q: str, index: Index, stemmed: bool = True,
           view: View = "unread", feed_id: int | None = None, folder: str | None = None, page: int = 0,
           page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of matches, best first, newer first on ties. The view filter does not apply; feed and folder do.

    ``index`` was built with the same ``stemmed``. Only the page's rows meet the wide items. A query without a letter or
    digit is the plain list of ``view``.
    """
    terms = query_terms(items.sparkSession, q, stemmed)
    if not terms:
        listed = list_items(items, feeds, view, feed_id, folder, page, page_size=page_size)
        return listed.withColumn("score", F.lit(None).cast("double"))
    scoped = in_scope(items.select("item_id", "feed_id"), feeds, feed_id, folder).select("item_id")
    best = [F.col("score").desc(), F.col("item_id").desc()]
    top = bm25(index, terms).join(scoped, "item_id", "left_semi").orderBy(*best).offset(page * page_size).limit(page_size)
    return with_feed(items.join(top, "item_id"), feeds, "score").orderBy(*best).limit(page_size)


def search_count(items: DataFrame, feeds: DataFrame, q: str, index: Index, stemmed: bool = True,
                 feed_id: int | None = None, folder: str | None = None) -> DataFrame:
    scoped = in_scope(items.select("item_id", "feed_id"), feeds, feed_id, folder)
    return match(index, query_terms(items.sparkSession, q, stemmed)).join(scoped, "item_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
