"""Exact top-k search by inner product: columnar branch and bound.

Components become integers floor(scale * x). Queries and candidates are cut into blocks, and each pair of blocks is one
piece of work. Candidates lie in vertical layout, one array per dimension. A query adds up its products dimension block
by dimension block, its heaviest dimensions first; after each block what a candidate can still gain or lose is at most
the product of the two remaining masses (Cauchy-Schwarz), and candidates whose best cannot reach the k-th worst are
compacted away. Scores are exact; ties go to the smaller id.

Vectors that are null or hold a null or non-finite component take no part, and vectors meet only those of their own
length. Rows that repeat an id are rows of their own: only the query's own row is left out. Rows with a null id take no
part. Sums must stay below 2**53, that is components below 2**22 for 512 dimensions.

Empty tables give no rows, and other columns may have any name.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm.common import group_bounds, whole_groups
from feedloom.session import stored

#: Queries and candidates of a block, and dimensions between two looks at the bounds.
QUERIES, CANDIDATES, DIMENSIONS = 256, 8192, 16


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, dim, vec): the vectors that take part, in integers."""
    whole = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.size(vec_col).alias("dim"), whole.alias("vec"))


def best(query: np.ndarray, columns: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and scores of the candidates that may be among the k best of this block; ``own`` is left out (-1: none).

    ``columns`` is dimensions x candidates. No candidate that belongs to the k best is dropped.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    alive = np.arange(columns.shape[1])
    if own >= 0:
        alive = np.delete(alive, own)
    total = np.zeros(len(alive))
    query_mass = np.append(np.cumsum((query[order] ** 2)[::-1])[::-1], 0.0)
    mass = (columns ** 2).sum(axis=0)[alive] if len(query) > DIMENSIONS else None
    for at in range(0, len(query), DIMENSIONS):
        dims = order[at:at + DIMENSIONS]
        part = columns[dims] if len(alive) == columns.shape[1] else columns[np.ix_(dims, alive)]
        total = total + query[dims] @ part
        if at + DIMENSIONS >= len(query):
            break
        mass = mass - (part ** 2).sum(axis=0)
        if len(alive) > k:
            # All sums are whole numbers, so one unit covers the rounding of the root.
            reach = np.sqrt(query_mass[at + DIMENSIONS] * mass) + 1
            worst = np.partition(total - reach, len(alive) - k)[len(alive) - k]
            keep = total + reach >= worst
            alive, total, mass = alive[keep], total[keep], mass[keep]
    return alive, total


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k highest scores among all other rows."""
    vectors = stored(integer_vectors(rows, id_col, vec_col, scale))
    # The condition may use the id column only; it is read from the stored vectors.
    marked = vectors.withColumnRenamed("id", id_col).withColumn("asks", F.coalesce(is_query, F.lit(False))).withColumnRenamed(id_col, "id")
    n, asked = marked.agg(F.count(F.lit(1)), F.sum(F.col("asks").cast("long"))).first()
    blocks = -(-(n or 1) // CANDIDATES)
    query_blocks = -(-(asked or 1) // QUERIES)
    place = F.xxhash64("row")
    queries = marked.filter("asks").select(
        "dim", F.pmod(place, F.lit(query_blocks)).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("c"),
        F.lit(0).alias("side"), "row", "id", "vec")
    candidates = marked.select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("q"), F.pmod(place, F.lit(blocks)).alias("c"),
        F.lit(1).alias("side"), "row", "id", "vec")
    met = queries.union(candidates).repartition("dim", "q", "c").sortWithinPartitions("dim", "q", "c", "side")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["dim", "q", "c"]):
            bounds = group_bounds(frame, ["dim", "q", "c"])
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                group = frame.iloc[s:e]
                ask, have = group[group["side"] == 0], group[group["side"] == 1]
                if len(ask) and len(have):
                    yield answers(ask, have, k)

    found = met.mapInPandas(search, "query_row long, query_id long, id long, score long")
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")


def answers(ask: pd.DataFrame, have: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one candidate block for each query of one query block."""
    ids, rows = have["id"].to_numpy(), have["row"].to_numpy()
    columns = np.ascontiguousarray(np.stack(have["vec"].to_numpy()).T.astype(np.float64))
    place = {r: i for i, r in enumerate(rows)}
    out = []
    for row, name, vec in zip(ask["row"], ask["id"], ask["vec"], strict=True):
        alive, score = best(np.asarray(vec, dtype=np.float64), columns, k, place.get(row, -1))
        first = np.lexsort((ids[alive], -score))[:k]
        out.append(pd.DataFrame({"query_row": row, "query_id": name, "id": ids[alive[first]], "score": score[first].astype(np.int64)}))
    return pd.concat(out, ignore_index=True)
