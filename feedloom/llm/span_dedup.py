"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and sentences of more than ``CLAUSE`` words into clauses. From every clause on, the shortest
run of consecutive clauses with at least ``words`` words is a span; so is the shortest run that ends at a clause where no
other span ends, so that a repeated passage is covered to its last clause. Spans are hashed over their lower-cased words,
joined globally, and every clause covered by a span that is not the first of its kind is removed. The first occurrence is
that in the least doc_id, and inside a document the first from its start.

A passage of n words that stands in several documents is removed from all but the first if ``words`` or more of its words
are whole clauses, thus whatever the sentences around it, where n is at least ``words`` plus the words of its two outer
sentences. Long sentences are cut on a grid from their start, so inside them a passage is found only where it lies alike.

With a ``run`` (of words; the query has 50), every run of so many words that stands in an earlier document, or earlier in the same text
without overlap, is removed as well, wherever it begins, word by word. Here a letter of a script that sets no spaces
is a word. Winnowing picks in every run the least hash of its ``GRAM`` words, the same in all its copies; only runs whose
pick repeats, and is not all covered by spans already, are hashed and joined.

Texts of fewer than ``words`` words have no span. Nulls count as empty and come back as they were. Rows that
share a doc_id are one document to the order of occurrences: what they share stays in both. Null ids come first.

Empty tables give no rows; texts of any length are read whole; of equal hashes in one document the first place counts;
other columns may have any name.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import BASE, BASE_INVERSE, WordHasher, _powers, mix64, slim_batches, whole_text
from feedloom.session import stored

#: A span has at least this many words, and a clause at most this many.
WORDS, CLAUSE = 30, 12
#: Sentence ends: white space behind a closing mark, or a line end. Only where a match ends counts.
_ENDS = re.compile(r"[.!?。！？…]\s+|\n\s*")
_WORD = re.compile(r"\S+")
#: Words of the pieces that are picked from runs.
GRAM = 16
#: Letters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_LETTER = re.compile(f"[{_UNSPACED}]")
_TOKEN = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+")


def sentence_bounds(text: str) -> list[int]:
    """Where sentences begin, with the length of the text at the end. White space belongs to the sentence before it."""
    return [0, *(m.end() for m in _ENDS.finditer(text) if 0 < m.end() < len(text)), len(text)]


class Spans:
    """The clauses of a text and the hashes of its spans."""

    def __init__(self, hasher: WordHasher, words: int):
        self.hasher, self.words = hasher, words
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def clauses(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Words before each clause (with the total at the end), and the sentence each clause lies in."""
        bounds = sentence_bounds(text)
        sizes = np.array([len(text[a:b].split()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=np.int64)
        parts = -(-sizes // CLAUSE)
        sentence = np.repeat(np.arange(len(sizes)), parts)
        before = np.cumsum(sizes) - sizes
        inside = np.arange(len(sentence)) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.append(before[sentence] + inside * CLAUSE, sizes.sum()), sentence

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First clause of every span, and the clause behind its last."""
        last = len(at) - 1
        ends = np.searchsorted(at, at[:-1] + self.words)
        first = np.flatnonzero(ends <= last)
        ends = ends[first]
        rest = np.setdiff1d(np.arange(1, last + 1), ends)
        begins = np.searchsorted(at, at[rest] - self.words, side="right") - 1
        rest, begins = rest[begins >= 0], begins[begins >= 0]
        return np.concatenate((first, begins)), np.concatenate((ends, rest))

    def hashed(self, given: list[str]) -> np.ndarray:
        return self.hasher(" ".join(given).encode("utf-8", "surrogatepass"))

    def of_words(self, hashed: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``s`` to before ``e``, from the hashes of all words."""
        if len(self.up) < len(hashed) + 1:
            self.up, self.down = _powers(BASE, 2 * len(hashed) + 1), _powers(BASE_INVERSE, 2 * len(hashed) + 1)
        total = np.zeros(len(hashed) + 1, dtype=np.uint64)
        np.cumsum(hashed * self.up[:len(hashed)], dtype=np.uint64, out=total[1:])
        return mix64((total[e] - total[s]) * self.down[s] + (e - s).astype(np.uint64))

    def __call__(self, text: str, hashed: np.ndarray):
        """(hash, begin, end) of every span, from the hashes of the lower-cased words."""
        at, _ = self.clauses(text)
        begins, ends = self.runs(at)
        return self.of_words(hashed, at[begins], at[ends]).view(np.int64), begins, ends


def tokens(text: str) -> list[str]:
    """The lower-cased words of a text; a letter of a script without spaces is one."""
    text = text.lower()
    return text.split() if text.isascii() or not _LETTER.search(text) else _TOKEN.findall(text)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by windows that double."""
    out, k = values, 1
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    rest = width - k
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class Picks:
    """The runs of ``run`` words of a text: the hash of each, and of the piece picked from it."""

    def __init__(self, spans: Spans, run: int):
        self.spans, self.run, self.gram = spans, run, min(GRAM, run)
        self.width = run - self.gram + 1

    def picks(self, hashed: np.ndarray) -> np.ndarray:
        """For every run the hash of its piece."""
        if len(hashed) < self.run:
            return np.empty(0, dtype=np.int64)
        s = np.arange(len(hashed) - self.gram + 1)
        return least(self.spans.of_words(hashed, s, s + self.gram), self.width).view(np.int64)

    def distinct(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes picked from a text, and whether runs without overlap may share them: then the pick holds for two
        stretches of runs, or for one longer than a piece can serve."""
        picked = self.picks(hashed)
        if not len(picked):
            return picked, np.empty(0, dtype=bool)
        at = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
        found, inverse, count = np.unique(picked[at], return_inverse=True, return_counts=True)
        again = count > 1
        again[inverse[np.diff(np.append(at, len(picked))) > self.width]] = True
        return found, again

    def runs(self, text: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, begin, again) of the runs whose pick is wanted; ``again``: it stood before without overlap."""
        words = self.spans.hashed(tokens(text))
        at = np.flatnonzero(np.isin(self.picks(words), wanted))
        hashed = self.spans.of_words(words, at, at + self.run).view(np.int64)
        _, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        return hashed, at, at - at[first][inverse] >= self.run


def open_picks(texts: DataFrame, words: int, run: int) -> DataFrame:
    """The ``later`` picks of runs that hold a word which no covered span holds."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans = Spans(WordHasher(), words)
        picks = Picks(spans, run)
        for frame in frames:
            out = []
            for text, later, b, e in zip(frame["text"], frame["later"], frame["begins"], frame["ends"], strict=True):
                hashed = picks.picks(spans.hashed(tokens(text)))
                left = np.isin(hashed, np.asarray(later))
                if b is not None and left.any():
                    # Words that stay, counted before every word.
                    stay = np.concatenate(([0], np.cumsum(~covered_words(text, spans, b, e))))
                    left &= stay[run:] > stay[:-run]
                out.append(np.unique(hashed[left]))
            if out:
                yield pd.DataFrame({"hash": np.unique(np.concatenate(out))})

    return texts.select("text", "later", "begins", "ends").mapInPandas(work, "hash long")


def wanted_runs(texts: DataFrame, words: int, run: int) -> DataFrame:
    """(doc, mark, hash, at, again): the runs whose pick is ``wanted``."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        picks = Picks(Spans(WordHasher(), words), run)
        for frame in frames:
            out = [picks.runs(text, np.asarray(wanted)) for text, wanted in zip(frame["text"], frame["wanted"], strict=True)]
            sizes = [len(h) for h, _, _ in out]
            if out:
                hashed, at, again = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"doc": np.repeat(frame["doc"].to_numpy(), sizes), "mark": np.repeat(frame["mark"].to_numpy(), sizes),
                                    "hash": hashed, "at": at, "again": again})

    return texts.select("doc", "mark", "text", "wanted").mapInPandas(
        work, "doc long, mark long, hash long, at int, again boolean")


def repeated_runs(keyed: DataFrame, picks: DataFrame, covered: DataFrame, words: int, run: int) -> DataFrame:
    """(__doc, __mark, __runs): the first words of all runs that repeat earlier ones and are not all ``covered``."""
    def firsts(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("again").alias("twice")).filter(
            "first < last or twice").select("hash", "first"))

    later = F.col("again") | (F.col("doc") > F.col("first"))
    found = stored(picks.join(firsts(picks), "hash").select("doc", "mark", "hash", later.alias("later")))
    lists = found.groupBy("doc", "mark").agg(F.collect_set(F.when(F.col("later"), F.col("hash"))).alias("later"))
    # Only texts with a repeated pick are written.
    texts = stored(keyed.dropDuplicates(["doc", "mark"]).join(lists, ["doc", "mark"]).join(
        covered.select(F.col("__doc").alias("doc"), F.col("__mark").alias("mark"), F.col("__covered.begin").alias("begins"),
                       F.col("__covered.end").alias("ends")), ["doc", "mark"], "left"))
    wanted = stored(open_picks(texts.filter(F.size("later") > 0), words, run).distinct())
    holders = found.join(wanted, "hash").groupBy("doc", "mark").agg(F.collect_set("hash").alias("wanted"))
    runs = stored(wanted_runs(texts.join(holders, ["doc", "mark"]), words, run))
    return runs.join(firsts(runs), "hash").filter(later).groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(
        F.collect_set("at").alias("__runs"))


def occurrences(docs: DataFrame, words: int, run: int | None) -> DataFrame:
    """(pick, doc, mark, again, hash, begin, end): each span's first occurrence in its document; later ones are ``again``.
    With a ``run`` also the distinct picks of every text, in one pass, as the words are hashed once."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans = Spans(WordHasher(), words)
        picks = Picks(spans, run) if run else None
        for frame in frames:
            out = []
            for doc, mark, text in zip(frame["doc"], frame["mark"], frame["text"], strict=True):
                given = tokens(text) if run else []
                hashed = spans.hashed(given)
                plain = text.isascii() or not _LETTER.search(text)
                found, begins, ends = spans(text, hashed if run and plain else spans.hashed(text.lower().split()))
                order = np.lexsort((begins, found))
                found, begins, ends = found[order], begins[order], ends[order]
                again = np.append(False, found[1:] == found[:-1])[:len(found)]
                out.append((doc, mark, False, again, found, begins, ends))
                if picks:
                    found, again = picks.distinct(hashed)
                    none = np.zeros(len(found), dtype=np.int64)
                    out.append((doc, mark, True, again, found, none, none))
            sizes = [len(o[4]) for o in out]
            if sum(sizes):
                yield pd.DataFrame({
                    **{c: np.repeat([o[k] for o in out], sizes) for k, c in enumerate(("doc", "mark", "pick"))},
                    **{c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("again", "hash", "begin", "end"), 3)}})

    return docs.select("doc", "mark", "text").mapInPandas(
        work, "doc long, mark long, pick boolean, again boolean, hash long, begin int, end int")


def remove_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
                   run: int | None = None) -> DataFrame:
    """The rows of ``docs`` with their text freed of repeated spans, and of all repeated runs of ``run`` words where that is
    given; ``n_removed`` clauses lost words (a column of that name gives way)."""
    slim_batches(docs.sparkSession)
    # ``mark`` tells rows with the same id but another text apart.
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"),
                        F.xxhash64(whole_text(text_col)).alias("mark"), whole_text(text_col).alias("text"))
    found = stored(occurrences(keyed, words, run), "pick")
    seen, picks = found.filter("not pick"), found.filter("pick").select("doc", "mark", "hash", "again")
    # Written, so that the join reads it by an exchange of its own and Spark can split the rows of a hot span.
    firsts = stored(seen.filter("not again").groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter(
        "first < last").select("hash", "first"))
    span = ["doc", "mark", "begin", "end"]
    later = seen.filter("not again").join(firsts, "hash").filter("doc > first").select(*span)
    covered = later.union(seen.filter("again").select(*span)).groupBy("doc", "mark").agg(
        F.collect_set(F.struct("begin", "end")).alias("__covered")).toDF("__doc", "__mark", "__covered")
    texts = docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
                              "__mark": F.xxhash64(whole_text(text_col))})
    if run is None:
        joined = texts.join(covered, ["__doc", "__mark"], "left").withColumn("__runs", F.lit(None).cast("array<int>"))
    else:
        covered = stored(covered)
        runs = stored(repeated_runs(keyed, picks, covered, words, run))
        joined = texts.join(covered, ["__doc", "__mark"], "left").join(runs, ["__doc", "__mark"], "left")
    cut = rewrite(words, run)
    out = joined.withColumn("__new", F.when(F.col("__covered").isNotNull() | F.col("__runs").isNotNull(), cut(
        whole_text(text_col), F.col("__covered.begin"), F.col("__covered.end"), F.col("__runs"))))
    return out.select(*(F.coalesce("__new.text", text_col).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_removed"),
                      F.coalesce("__new.removed", F.lit(0)).alias("n_removed"))


def rewrite(words: int, run: int | None):
    @F.pandas_udf("text string, removed int")
    def cut(texts: pd.Series, begins: pd.Series, ends: pd.Series, runs: pd.Series) -> pd.DataFrame:
        spans = Spans(WordHasher(), words)
        out = []
        for text, b, e, r in zip(texts, begins, ends, runs, strict=True):
            out.append((text, 0) if not text or b is None and r is None else without(text, spans, b, e, r, run))
        return pd.DataFrame(out, columns=["text", "removed"])

    return cut


def covered_clauses(at: np.ndarray, begins, ends) -> np.ndarray:
    """Which clauses lie in [begin, end) of any span."""
    count = np.zeros(len(at), dtype=np.int64)
    np.add.at(count, np.asarray(begins), 1)
    np.add.at(count, np.asarray(ends), -1)
    return np.cumsum(count)[:-1] > 0


def covered_words(text: str, spans: Spans, begins, ends) -> np.ndarray:
    """Which tokens lie in covered clauses."""
    at, _ = spans.clauses(text)
    gone = np.repeat(covered_clauses(at, begins, ends), np.diff(at))
    if text.isascii() or not _LETTER.search(text):
        return gone
    # A word of a script without spaces is several tokens.
    return np.repeat(gone, [len(_TOKEN.findall(w)) for w in text.split()])


def cut_places(text: str, spans: Spans, begins, ends) -> tuple[list[tuple[int, int]], list[int]]:
    """Where the clauses in [begin, end) of any span lie in the text, and where every clause begins, with the text's end."""
    at, _ = spans.clauses(text)
    starts = [m.start() for m in _WORD.finditer(text)]
    place = [starts[w] for w in at[:-1]] + [len(text)]
    place[0] = 0
    gone = () if begins is None else np.flatnonzero(covered_clauses(at, begins, ends))
    return [(place[k], place[k + 1]) for k in gone], place


def without(text: str, spans: Spans, begins, ends, runs=None, run: int | None = None) -> tuple[str, int]:
    """The text without the clauses in [begin, end) of any span and the runs that begin at these words, and how many
    clauses lost words."""
    cuts, place = cut_places(text, spans, begins, ends)
    if runs is not None:
        starts = [m.start() for m in _TOKEN.finditer(text)] + [len(text)]
        starts[0] = 0
        cuts += [(starts[w], starts[w + run]) for w in np.asarray(runs)]
    if not cuts:
        return text, 0
    cuts = np.array(sorted(cuts))
    # Cuts that touch are one; a clause inside several cuts counts once.
    reach = np.maximum.accumulate(cuts[:, 1])
    new = np.append(True, cuts[1:, 0] > reach[:-1])
    froms, tos = cuts[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(cuts)) - 1]
    place = np.asarray(place)
    lost = np.zeros(len(place), dtype=np.int64)
    np.add.at(lost, np.searchsorted(place, froms, side="right") - 1, 1)
    np.add.at(lost, np.searchsorted(place, tos, side="left"), -1)
    kept = zip([0, *tos.tolist()], [*froms.tolist(), len(text)], strict=True)
    return "".join([text[a:b] for a, b in kept]), int((np.cumsum(lost)[:-1] > 0).sum())
