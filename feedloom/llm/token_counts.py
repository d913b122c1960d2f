"""Token counts of whole texts by a two-tier lookup on the map side.

First tier: a compact table of the most frequent pre-tokens and their lengths in tokens, broadcast to every worker. Its
size is a parameter, so it does not grow with the corpus. Second tier: what the table lacks is encoded by the library and
remembered in the worker's own bounded cache. No pre-token is shuffled; only the summaries that choose the table are, at
most ``per_task`` rows from every task over the whole corpus.

Null texts are empty: no bytes, no tokens.

Empty tables give no rows; equal rows are counted each; texts of any length are read whole; other columns may have any
name.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import rows_frame, slim_batches, whole_text
from feedloom.llm.encoders import MARK, Remembered, piece_lengths, pieces

#: Pre-tokens in the broadcast table: at most 32 characters each, so a few megabytes.
TABLE, LONGEST = 1 << 16, 32
#: Counters a task keeps while it sums up its part, and how many it hands on.
COUNTERS, PER_TASK = 1 << 18, 1 << 13


def frequent_pieces(docs: DataFrame, text_col: str, table: int, per_task: int) -> list[str]:
    """The most frequent pre-tokens over all texts, from each task's lossy counts. The choice only decides what is
    looked up first; counts of tokens are exact whatever it holds."""

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                if text and MARK not in text:  # such a text is one piece, too long to be looked up
                    seen.update(pieces(text))
            if len(seen) > COUNTERS:  # what came once or twice so far gives way
                seen = Counter({p: n for p, n in seen.items() if n > 2})
                if len(seen) > COUNTERS:
                    seen = Counter(dict(seen.most_common(COUNTERS // 2)))
        best = [(p, n) for p, n in seen.most_common(per_task) if n > 1 and len(p) <= LONGEST]
        yield rows_frame(best, ("piece", "n"))

    summaries = docs.select(whole_text(text_col).alias("text")).mapInPandas(summarise, "piece string, n long")
    top = summaries.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table)
    return [r["piece"] for r in top.collect()]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, table: int = TABLE, per_task: int = PER_TASK,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    slim_batches(spark)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    words = frequent_pieces(docs, text_col, table, per_task)
    first_tier = spark.sparkContext.broadcast(dict(zip(words, map(len, model.encode(words, num_threads=1)), strict=True)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = piece_lengths(model_file)
        lengths = TwoTiers(first_tier.value, rest)
        for frame in frames:
            texts = frame["text"]
            yield pd.DataFrame({
                id_col: frame["id"],
                "n_bytes": [len(t.encode("utf-8")) for t in texts],
                "n_tokens": [sum(map(lengths.__getitem__, pieces(t))) if t else 0 for t in texts]})

    id_type = docs.schema[id_col].dataType.simpleString()
    # Ids pass through Python as text, so that a null among them does not turn them into floats.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), whole_text(text_col).alias("text")).mapInPandas(
        count, f"{id_col} string, n_bytes long, n_tokens long")
    return rows.withColumn(id_col, F.col(id_col).cast(id_type)).withColumn("over_limit", F.col("n_tokens") > limit)


class TwoTiers(dict):
    """The broadcast table; what it lacks comes from the worker's cache."""

    def __init__(self, table: dict, rest: Remembered):
        super().__init__(table)
        self.rest = rest

    def __missing__(self, piece):
        return self.rest[piece]
