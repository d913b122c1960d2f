"""Session settings and checkpointing."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_STORED: list[str] = []


def get_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with AQE on. Sizing (executors, shuffle partitions) is the cluster's to set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    pinned = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in {**pinned, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of rows that one Python worker is given at a time.
PYTHON_BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bodies and pages go to Python in batches of few bytes, whatever number of rows fits; a smaller bound that is set, or one in another unit, stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.sql(f"set {key}").first()["value"].rstrip("b")
    if held.isdigit() and int(held) > PYTHON_BATCH_BYTES:
        spark.conf.set(key, str(PYTHON_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="feedloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as a table under the shared folder and read it back.

    Later jobs and replaced executors then re-read columns instead of repeating the work, and the planner knows the
    real size of what it reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/feedloom/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession, kept: int = 0) -> None:
    """Delete the tables this process stored, but for the first ``kept``. Frames that read them must not be used afterwards."""
    while len(_STORED) > kept:
        remove(spark, _STORED.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is stored inside: for work that repeats, as a stream's batches do."""
    before = len(_STORED)
    try:
        yield
    finally:
        release(spark, before)
