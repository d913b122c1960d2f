"""List pages: what building and running them reads."""
from pyspark.sql import functions as F

from feedloom.operators import lists


def test_a_page_is_built_without_a_job_and_reads_its_part_of_the_table(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.col("id").alias("item_id"), (F.col("id") % 7).alias("feed_id"), F.lit(None).cast("string").alias("url"), F.lit("t").alias("title"),
        F.lit("a").alias("author"), F.lit("s").alias("summary"), F.repeat(F.col("id").cast("string"), 40).alias("content"),
        F.timestamp_seconds("id").alias("published_at"), F.timestamp_seconds("id").alias("fetched_at"),
        F.lit(0).alias("is_read"), F.lit(0).alias("is_starred"))
    rows.repartitionByRange(20, "item_id").write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    feeds = spark.range(7).select(F.col("id").alias("feed_id"), F.lit("f").alias("title"), F.lit("s").alias("site_url"), F.lit("x").alias("folder"))
    spark.sparkContext.setJobGroup("built", "built")
    page = lists.list_items(items, feeds, "all", folder="x", page=2)
    behind = lists.list_items(items, feeds, "unread", after=("1970-01-01 02:00:00", 0))
    empty = lists.list_items(items.limit(0), feeds)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("built")) == []
    spark.sparkContext.setJobGroup("run", "run")
    assert [r.item_id for r in page.collect()] == list(range(39_799, 39_699, -1))
    assert [r.item_id for r in behind.collect()] == list(range(7_199, 7_099, -1))
    assert empty.collect() == []
    assert scanned(page._jdf.queryExecution().executedPlan(), "content") < 5_000


def scanned(plan, column: str) -> int:
    """Rows that the scans of ``column`` gave."""
    inner = {"AdaptiveSparkPlan": "executedPlan"}.get(plan.nodeName().split(" ")[0]) or ("plan" if "QueryStage" in plan.nodeName() else None)
    if inner:
        return scanned(getattr(plan, inner)(), column)
    here = plan.metrics().get("numOutputRows").get().value() if "Scan" in plan.nodeName() and f"{column}#" in plan.toString() else 0
    return here + sum(scanned(plan.children().apply(i), column) for i in range(plan.children().size()))


def test_a_saved_index_cuts_texts_into_terms_once(spark, tmp_path):
    """A step reads its texts once; its totals are those of its rows, those without a term too."""
    from feedloom.operators.search import SavedIndex

    read = spark.sparkContext.accumulator(0)

    def text(i):
        read.add(1)
        return None if i == 3 else f"w{i} and and"

    ids = spark.range(1, 6).withColumnRenamed("id", "item_id")
    columns = {"title": F.lit(None).cast("string"), "author": F.lit(""), "summary": F.lit(" ")}
    items = ids.withColumn("content", F.udf(text, "string")("item_id")).withColumns(columns)
    saved = SavedIndex(spark, f"{tmp_path}/index", stemmed=False)
    saved.add(items, 1)
    assert read.value == 5
    assert [(r.n, r.held) for r in saved.live()] == [(5, 12)]
    saved.remove(items.filter("item_id < 3"), 2)
    index = saved.open()
    assert index.n == 3 and round(index.avgdl * 3) == 6 and index.counts(["and", "w1", "w4"]) == {"and": 2, "w1": 0, "w4": 1}
