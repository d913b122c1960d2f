"""Similarity self-join on word n-grams: all pairs of texts whose n-gram sets have a Jaccard similarity of at least 0.8.

MinHash values are compared a few at a time, and a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below a tolerance; what is left is verified on the n-gram sets themselves.

1. Equal n-gram sets become one node, so copies never meet each other.
2. Nodes that agree in a band of MinHash values share a bucket. Buckets with the same members count once; large buckets
   are cut into blocks and compared block against block. A bucket gives back no pairs, only which of its nodes hang
   together through pairs that survived the pruning.
3. Clusters of such nodes are compared block against block again, now with their n-gram sets. A task counts the verified
   links of its nodes and gives back counts and connections, at most one row per node and block.

Result: one row per document with its class (the least id that verified links lead to) and its number of links, that is
of other documents at or above the threshold. Texts without words link to nothing and are a class of their own. Texts of
fewer words than an n-gram have one n-gram, all their words. Nulls count as empty.

Empty tables give no rows; texts of any length are read whole; equal rows are one node and come back each; other
columns may have any name.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import GOLDEN, WordHasher, group_bounds, mix64, slim_batches, whole_groups, whole_text
from feedloom.llm.components import components
from feedloom.session import stored

#: MinHash values, and how many of them make a band. At a similarity of 0.8 a pair misses all bands with odds of 3 in a
#: million, at 0.85 of 7 in a billion.
VALUES, BAND = 160, 5
#: Values compared between two looks at the posterior, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 20, 1e-6
#: Most nodes of a block, and about how many n-grams a block holds.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: Classes are copied to this many slices of their documents before they are joined.
SLICES = 16

_rng = np.random.default_rng(20)
_XORS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(text: str, n: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; words are split at white space and lower-cased."""
    words = hasher(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = total * GOLDEN + words[k:len(words) - width + 1 + k]
    return np.unique(mix64(total + np.uint64(width)))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One byte of each MinHash value per set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), dtype=np.uint8)
    for k in range(VALUES):
        least = np.minimum.reduceat((joined ^ _XORS[k]) * _FACTORS[k], starts)
        out[:, k] = mix64(least) >> np.uint64(56)
    return out


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For every look, the least number of equal values with which a pair goes on.

    One byte of two different values agrees once in 256, so values agree with p = s + (1 - s) / 256. With a uniform prior
    the posterior after m of n is Beta(m + 1, n - m + 1), whose tail above t is the chance of at most m in n + 1 at t.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def surviving(values: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no look dropped; each look compares the next values of the pairs that are left."""
    matches = np.zeros(len(left), dtype=np.int32)
    for k, needed in enumerate(least):
        part = values[:, k * STEP:(k + 1) * STEP]
        matches += (part[left] == part[right]).sum(axis=1, dtype=np.int32)
        keep = matches >= needed
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def block_pairs(block: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs between block i and block j of a group, or inside it where they are the same, a few rows at a time."""
    mine, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for at in range(0, len(mine), 64):
        left, right = (x.ravel() for x in np.meshgrid(mine[at:at + 64], other, indexing="ij"))
        if i == j:
            left, right = left[left < right], right[left < right]
        if len(left):
            yield left, right


def roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index that each index hangs together with."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each pair shares. Few pairs are merged one by one; many go through blocks of a 0/1 matrix."""
    if len(left) <= 32:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    renumber = np.cumsum(seen > 1) - 1
    owner, column = owner[shared], renumber[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    wide = 2048
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [c, c + wide])
        part = np.zeros((len(sets), wide), dtype=np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def sketch(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, k1, k2, sig): size and key of each document's n-gram set, and its MinHash bytes. Ids pass through
    Python as text, so that a null among them does not turn them into floats."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for frame in frames:
            sets = [ngrams(t, n, hasher) for t in frame["text"]]
            some = [k for k, s in enumerate(sets) if len(s)]
            sig: list = [b""] * len(sets)
            at = 0
            while at < len(some):  # about 64k n-grams at a time stay in the processor's cache
                end, grams = at, 0
                while end < len(some) and (grams < 1 << 16):
                    grams += len(sets[some[end]])
                    end += 1
                for k, row in zip(some[at:end], minhashes([sets[k] for k in some[at:end]]), strict=True):
                    sig[k] = row.tobytes()
                at = end
            keys = [set_key(s) for s in sets]
            yield pd.DataFrame({"id": frame["id"], "n": [len(s) for s in sets], "k1": [k[0] for k in keys],
                                "k2": [k[1] for k in keys], "sig": sig})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInPandas(work, "id string, n int, k1 long, k2 long, sig binary").withColumn(
        "row", F.monotonically_increasing_id())


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell n-gram sets apart."""
    if not len(s):
        return 0, 0
    return int(mix64(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(s + GOLDEN)).view(np.int64))


def bucket_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): which nodes hang together through bucket mates that survived the pruning."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)),
                        lambda b: F.xxhash64(b, F.substr("sig", b * BAND + 1, F.lit(BAND))))
    slim = nodes.select("row", F.explode(bands).alias("bucket"))
    # Copies of a cluster share most buckets; buckets with the same members are compared once.
    wanted = stored(slim.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("row").alias("lo"), F.max("row").alias("hi"),
        F.bit_xor(F.xxhash64("row")).alias("members"))
        .filter("size > 1").groupBy("size", "lo", "hi", "members").agg(F.min("bucket").alias("bucket"))
        .select("bucket", "size"))
    mates = slim.join(wanted, "bucket").join(nodes.select("row", "sig"), "row")
    least = least_matches(threshold, TOLERANCE)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["bucket", "i", "j"]):
            bounds = group_bounds(frame, ["bucket", "i", "j"])
            rows, block = frame["row"].to_numpy(), frame["block"].to_numpy()
            i, j = frame["i"].to_numpy(), frame["j"].to_numpy()
            values = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint8).reshape(-1, VALUES)
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                found = [surviving(values[s:e], a, b, least) for a, b in block_pairs(block[s:e], i[s], j[s])]
                found = [f for f in found if len(f[0])]
                if found:
                    root = roots(e - s, *(np.concatenate(x) for x in zip(*found, strict=True)))
                    hang = np.flatnonzero(root != np.arange(e - s))
                    out.append((rows[s:e][hang], rows[s:e][root[hang]]))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"a": a, "b": b})

    return in_blocks(mates, "bucket", F.ceil(F.col("size") / BLOCK)).select(
        "bucket", "i", "j", "block", "row", "sig").mapInPandas(work, "a long, b long")


def in_blocks(members: DataFrame, key: str, blocks) -> DataFrame:
    """Copy each member to the pairs of its block with every block of its group, and bring each pair of blocks together."""
    return (members.withColumn("blocks", blocks.cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
            .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "mate")).withColumn("j", F.greatest("block", "mate"))
            .repartition(key, "i", "j").sortWithinPartitions(key, "i", "j"))


def verified_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, n: int, threshold: float, id_col: str,
                   text_col: str) -> DataFrame:
    """(row, links, root): per node and pair of blocks, the documents it links to and the node it hangs together with."""
    sizes = clusters.join(nodes.select("row", "n"), "row").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams"))
    members = stored(clusters.join(nodes, "row").join(sizes, "cluster").withColumn(
        "blocks", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS))))
    # Only documents that stand for a clustered node are read again; their texts move once.
    texts = docs.select(F.col(id_col).cast("string").alias("_id"), whole_text(text_col).alias("text"))
    texts = texts.join(members.withColumnRenamed("id", "_own"), F.col("_id").eqNullSafe(F.col("_own")))

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for frame in frames:
            sets = [ngrams(t, n, hasher) for t in frame["text"]]
            # A repeated id may bring a text that is not the node's; its key tells.
            same = [set_key(s) == (a, b) for s, a, b in zip(sets, frame["k1"], frame["k2"], strict=True)]
            frame = frame.drop(columns=["text", "k1", "k2"]).assign(grams=[s.tobytes() for s in sets])
            yield frame[same]

    rows = texts.select("cluster", "blocks", "row", "copies", "sig", "k1", "k2", "text").mapInPandas(
        grams, "cluster long, blocks long, row long, copies long, sig binary, grams binary")
    least = least_matches(threshold, TOLERANCE)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["cluster", "i", "j"]):
            bounds = group_bounds(frame, ["cluster", "i", "j"])
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                group = frame.iloc[s:e].drop_duplicates("row")
                out = verify(group, int(group["i"].iloc[0]), int(group["j"].iloc[0]), least, threshold)
                if len(out):
                    yield out

    return in_blocks(rows, "cluster", F.col("blocks")).select(
        "cluster", "i", "j", "block", "row", "copies", "sig", "grams").mapInPandas(work, "row long, links long, root long")


def verify(group: pd.DataFrame, i: int, j: int, least: np.ndarray, threshold: float) -> pd.DataFrame:
    """Count the verified links between two blocks of a cluster, or inside one."""
    rows, copies, block = (group[c].to_numpy() for c in ("row", "copies", "block"))
    values = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(-1, VALUES)
    found = [surviving(values, a, b, least) for a, b in block_pairs(block, i, j)]
    found = [f for f in found if len(f[0])]
    if not found:
        return pd.DataFrame({"row": [], "links": [], "root": []})
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    sets = [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]]
    size = np.array([len(s) for s in sets])
    common = common_counts(sets, left, right)
    real = common >= threshold * (size[left] + size[right] - common) - 1e-9
    left, right = left[real], right[real]
    links = np.bincount(left, copies[right], len(rows)) + np.bincount(right, copies[left], len(rows))
    root = roots(len(rows), left, right)
    some = links > 0
    return pd.DataFrame({"row": rows[some], "links": links[some].astype(np.int64), "root": rows[root[some]]})


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, n_links."""
    slim_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    base = stored(sketch(docs, n, id_col, text_col).withColumn("key_id", F.col("id").cast(id_type)))
    alike = base.filter("n > 0").groupBy("k1", "k2", "n").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.min("key_id").alias("least_id"))
    nodes = stored(alike.join(base.select("row", "id", "sig"), "row"))
    roots_of = components(bucket_links(nodes, threshold), "a", "b")
    clusters = roots_of.select(F.col("node").alias("row"), F.col("root").alias("cluster")).union(
        roots_of.select("root", "root").distinct())
    links = stored(verified_links(docs, nodes, clusters, n, threshold, id_col, text_col))
    classes = components(links.select("row", "root"), "row", "root")
    counts = links.groupBy("row").agg(F.sum("links").alias("links"))
    # Nodes that are alone and stand for one document need no join: they are their own class.
    rich = (nodes.select("row", "k1", "k2", "n", "copies", "least_id").join(counts, "row", "left")
            .filter("copies > 1 or links is not null")
            .join(classes.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")))
    rich = stored(rich)
    least = rich.groupBy("root").agg(F.min("least_id").alias("class_id"))
    told = rich.join(least, "root").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return (base.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int"))
            .select("key_id", "k1", "k2", "n", "slice")
            .join(told.select("k1", "k2", "n", "slice", "class_id", "copies", "links"), ["k1", "k2", "n", "slice"], "left")
            .select(F.col("key_id").alias(id_col), F.coalesce("class_id", "key_id").alias("class_id"),
                    (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id stands for their class, that is the least one; all columns stay. Rows without an id
    stay, as no other row can stand for them by name; rows that repeat an id stay or go together."""
    found = ngram_join(docs, id_col=id_col, text_col=text_col, **how)
    dropped = found.filter(F.col(id_col) != F.col("class_id")).select(id_col).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
