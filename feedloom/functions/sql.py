"""The Python-backed functions by name, for SQL users."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from feedloom.functions.markup import SCHEMA, scan, scan_batches
from feedloom.functions.porter import porter_stem_udf
from feedloom.functions.urls import resolve_url_udf
from feedloom.schemas import NODES


class PageNodes:
    """``select * from page_nodes(table(select page_id, url, html from pages))``: a table of pages in Arrow batches, its elements out."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        given = [pages.column(c) for c in ("page_id", "url", "html")] + [pa.nulls(len(pages), pa.string())]
        yield from scan_batches(iter([pa.RecordBatch.from_arrays(given, names=["page_id", "url", "html", "error"])]))


class HtmlNodes:
    """``select n.* from pages p, lateral html_nodes(p.page_id, p.url, p.html) n``, page by page beside other columns."""

    def eval(self, page_id: int, url: str, html: str) -> Iterator[tuple]:
        for row in scan(html or ""):
            attrs = dict(row["attrs"])
            given = {**row, "page_id": page_id, "base_url": url if "href" in attrs else None, "attrs": attrs}
            yield tuple(given.get(name) for name in SCHEMA.names)


def register(spark: SparkSession) -> None:
    spark.udf.register("porter_stem", porter_stem_udf)
    spark.udf.register("resolve_url", resolve_url_udf)
    spark.udtf.register("html_nodes", udtf(HtmlNodes, returnType=NODES))
    spark.udtf.register("page_nodes", arrow_udtf(PageNodes, returnType=NODES))
