"""Stored tables: plain Parquet in folders by bucket of the key and by batch.

A batch replaces its own folders when it is written again, so a repeated stream batch leaves one copy. Reads by key open
the folders of the keys' buckets only. A table is written by ``put`` alone; one that holds nothing yet reads as empty.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.session import remove

FEED_BUCKETS = 64


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_by: str | None = None, buckets: int = FEED_BUCKETS):
        self.spark, self.path, self.schema, self.bucket_by = spark, path.rstrip("/"), schema, bucket_by
        self.buckets = buckets if bucket_by else 1
        self.columns = [part.split()[0] for part in schema.split(", ")]

    def bucket(self, key: str | None = None) -> Column:
        key = key or self.bucket_by
        return (F.pmod(F.xxhash64(key), F.lit(self.buckets)) if key else F.lit(0)).cast("int")

    def _placed(self, df: DataFrame, batch: str) -> DataFrame:
        return df.select(*self.columns, self.bucket().alias("bucket"), F.lit(batch).alias("batch"))

    def rows(self) -> DataFrame:
        """The table with its folder columns ``bucket`` and ``batch``, by which reads are pruned."""
        schema = f"{self.schema}, bucket int, batch string"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, without: str | None = None) -> DataFrame:
        """All rows, or all but those of one batch."""
        rows = self.rows()
        return (rows if without is None else rows.filter(F.col("batch") != without)).select(*self.columns)

    def of_keys(self, keys: DataFrame, without: str | None = None) -> DataFrame:
        """The rows of some keys. The buckets asked for are a handful of numbers, and only their folders are read."""
        asked = [r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]
        rows = self.rows().filter(F.col("bucket").isin(asked) if asked else F.lit(False))
        rows = rows if without is None else rows.filter(F.col("batch") != without)
        return rows.select(*self.columns).join(keys.select(self.bucket_by).distinct(), self.bucket_by, "left_semi")

    def put(self, df: DataFrame, batch: str, *order: str) -> None:
        """Write the rows of a batch, in place of what the batch wrote before. Rows are brought together by bucket first:
        a bucket is one file, or several where it is large, in ``order`` inside."""
        placed = self._placed(df, batch).hint("rebalance", "bucket")
        placed = placed.sortWithinPartitions("bucket", *order) if order else placed
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)


class Snapshots(Table):
    """A keyed table whose buckets are replaced whole, by numbered versions: a bucket is what its newest version says.

    What a version that was not finished left behind is never seen by its repetition, which reads the versions before it and
    writes the same folders again. A read opens one version of each bucket, however many there were.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_by: str, buckets: int = FEED_BUCKETS):
        super().__init__(spark, path, f"{schema}, _live boolean", bucket_by, buckets)
        self.given = self.columns[:-1]

    def _newest(self, before: int | None, asked: list[int] | None) -> list[tuple[int, str]]:
        """(bucket, version) of what is to be read; at most one for each bucket."""
        rows = self.rows().select("bucket", "batch")
        rows = rows if before is None else rows.filter(F.col("batch") < _version(before))
        rows = rows if asked is None else rows.filter(F.col("bucket").isin(asked) if asked else F.lit(False))
        return [tuple(r) for r in rows.groupBy("bucket").agg(F.max("batch")).collect()]

    def as_of(self, before: int | None = None, asked: list[int] | None = None) -> DataFrame:
        """The table without versions from ``before`` on; of some buckets only where they are named."""
        by_version: dict[str, list[int]] = {}
        for bucket, batch in self._newest(before, asked):
            by_version.setdefault(batch, []).append(bucket)
        wanted = F.lit(False)
        for batch, held in by_version.items():
            wanted = wanted | ((F.col("batch") == batch) & F.col("bucket").isin(held))
        return self.rows().filter(wanted).filter("_live").select(*self.given)

    def read(self, without: str | None = None) -> DataFrame:
        return self.as_of()

    def asked(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys, at most as many as there are."""
        return sorted(r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect())

    def replace(self, df: DataFrame, asked: list[int], version: int) -> None:
        """Make ``df`` the whole of the buckets ``asked``. A row that is not live stands for each, so that an empty bucket is known to be."""
        marks = self.spark.createDataFrame([(b,) for b in asked], "bucket int").select(
            *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in self.given], F.lit(False).alias("_live"), "bucket")
        rows = df.select(*self.given, F.lit(True).alias("_live"), self.bucket().alias("bucket")).unionByName(marks)
        rows.withColumn("batch", F.lit(_version(version))).hint("rebalance", "bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)

    def expire(self, before: int) -> None:
        """Delete the versions that a read of everything before ``before`` no longer opens."""
        kept = dict(self._newest(before, None))
        old = self.rows().filter(F.col("batch") < _version(before)).select("bucket", "batch").distinct().toLocalIterator()
        for r in old:
            if r["batch"] != kept[r["bucket"]]:
                remove(self.spark, f"{self.path}/bucket={r['bucket']}/batch={r['batch']}")


def _version(n: int) -> str:
    """Versions as text in their order, so that no reader takes them for other numbers."""
    return f"v{n:018d}"
