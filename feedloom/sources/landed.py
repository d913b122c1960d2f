"""Landed crawl files: responses and pages, as a table or as a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.schemas import FETCHES, PAGES


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCHES).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def stream_fetches(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New response files as they land; ``max_files`` bounds a micro-batch."""
    return spark.readStream.schema(FETCHES).option("maxFilesPerTrigger", max_files).parquet(path)
