"""Best-fit packing planned on the histogram of lengths.

Documents are cut into pieces of at most ``size`` tokens. The plan never sees a piece, only how many there are of each
length: going down the lengths, the open sequences with the least room that still suffices are filled first. Sequences
that are filled alike form one run of consecutive numbers, so the plan is a few runs per length whatever the corpus size;
each run says which ranks of a length go where. Pieces then take their slots by their rank within their length.

Null texts are empty documents: they hold the end mark alone. A repeated doc_id is a document of its own.

Empty tables give no rows, and other columns may have any name; equal lengths take places by rank.
"""
from __future__ import annotations

import bisect
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from feedloom.llm.common import rows_frame, slim_batches, whole_text
from feedloom.llm.encoders import text_ids, word_ids
from feedloom.session import stored

#: Rows of one length are numbered in this many slices, so a length that a third of all pieces share is no single task.
SLICES = 256
PIECE_SCHEMA = "doc_id string, piece int, start long, length long, ids_crc32 long, row long"


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank from, rank to, first sequence, per sequence, offset) that place ``counts[length]`` pieces of
    every length: best fit, longest first, over counts. At most a few runs per length."""
    rooms: list[int] = []  # sorted rooms that some open run has
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]
    plan, opened = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = size, opened
                many = -(-left // (size // length))
                opened += many
            each = room // length
            full, rest = divmod(min(left, each * many), each)
            taken = full * each + rest
            plan.append((length, rank, rank + taken, first, each, size - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), many - full - bool(rest))
            rank, left = rank + taken, left - taken
    return plan


def cut_pieces(docs: DataFrame, tokenizer_file: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document, with the checksum of their ids. Ids stay in the task; slots need only lengths.

    Document ids pass through Python as text, so that a null among them does not turn them into floats."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_ids(tokenizer_file)
        end = int(end_id).to_bytes(4, "little")
        for frame in frames:
            out = []
            for row, doc, text in zip(frame["row"], frame["doc_id"], frame["text"], strict=True):
                ids = text_ids(cache, text) + end
                total = len(ids) // 4
                out += [(doc, k, k * size, min(size, total - k * size), crc32(ids[4 * k * size:4 * (k + 1) * size]), row)
                        for k in range(-(-total // size))]
            yield rows_frame(out, ("doc_id", "piece", "start", "length", "ids_crc32", "row"))

    slim_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("doc_id"),
                       whole_text(text_col).alias("text"))
    return rows.mapInPandas(cut, PIECE_SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def ranked(pieces: DataFrame) -> DataFrame:
    """0-based ``rank`` of every piece within its length: numbered inside slices, whose sizes add up before them."""
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("row", "piece"), F.lit(SLICES)).cast("int"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "slice").orderBy("row", "piece")
    return sliced.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["length", "slice"]).withColumn(
        "rank", F.col("before") + F.col("inside"))


def place(pieces: DataFrame, plan: list[tuple], size: int) -> DataFrame:
    """Join the ranked pieces with the planned runs on length and rank."""
    spark = pieces.sparkSession
    # At most a few runs per length, and lengths end at ``size``: a bounded table, whatever the corpus.
    runs = spark.createDataFrame(pd.DataFrame(plan, columns=["length", "from", "to", "first", "each", "offset"]).astype("int64")
                                 if plan else [], "length long, from long, to long, first long, each long, offset long")
    lists = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("from", "to", "first", "each", "offset"))).alias("runs"))
    at = F.col("rank") - F.col("run.from")
    joined = ranked(pieces).join(F.broadcast(lists), "length")
    run = F.element_at(F.filter("runs", lambda r: (r["from"] <= F.col("rank")) & (F.col("rank") < r["to"])), 1)
    return joined.withColumn("run", run).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first") + F.floor(at / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.offset") + F.pmod(at, F.col("run.each")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_file: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut_pieces(docs, tokenizer_file, size, end_id, id_col, text_col))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    return place(pieces, best_fit(counts, size), size)
