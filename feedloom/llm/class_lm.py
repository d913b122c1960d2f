"""Language-model scoring by Brown class-based n-grams.

Every word of the learning texts gets one class; a token's probability is that of its class after the class before it, times that
of the word inside its class. Texts are lower-cased (A to Z) and cut at ASCII white space; an end closes each text, is
a token with a class of its own, and stands before the first word.

- Counts: every task counts its words, Spark adds them up; the whole vocabulary stays a distributed table.
- Exchange: the most frequent words, at most ``exchanged``, begin in classes dealt by rank. In every round tasks count each such word's
  neighbours by class, and the words, one after the other, move to the class that raises the likelihood of the class bigrams most,
  half of them in a round, since the others' counts are those of the round's start. All other words, the whole rest of the vocabulary,
  then move once, each against the same class counts, in tasks partitioned by word.
- Encoding: texts become one byte a token. A bounded table of the most frequent words is broadcast; the words that it
  lacks are looked up in the vocabulary by a join, once for each text that holds them, and set into the bytes afterwards.
- Smoothing: class transitions are drawn towards the classes' shares; inside a class each word gives up a discount
  n1/(n1 + 2 n2), and what a class's words give up is its share of unseen words, spread over Chao's estimate of how many
  there are. So an unseen word is as unlikely as it should be, and its class is the likeliest after the class before.

Bounds: classes at most 250, the driver holds ``exchanged`` x 2(classes + 2) counts and the broadcast table's words; vocabulary, counts and
bigrams grow with the corpus and stay in Spark. Both sets of frequent words are whole steps of a scale of counts (64 to a
doubling), as many as fit, so that ties do not matter and no task sends its own top list. Null texts count as empty and have one token, the end. Repeated rows, also of one id, are scored each and learned from each; a null id comes back. Very long
texts are whole. Where nothing may be learned from, every token has probability 1, in base and score. Empty tables give
no rows. Only the id and the text are read, so other columns may have any name.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import slim_bytes, whole_text
from feedloom.session import stored

#: Word classes, rounds of exchange, words that take part in them, words of the broadcast table.
CLASSES, ROUNDS, EXCHANGED, TABLE = 64, 5, 8192, 1 << 18
#: Distinct words (or tokens) that a task holds before it hands them on; tokens of a stored piece.
HELD, PIECE = 1 << 18, 1 << 14
#: The end as a word (no word is empty), and the byte of a token without a class yet.
END, OPEN = b"", 255


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words: both calls know ASCII letters and white space only."""
    return data.lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, ends included."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Counter()

        def out():
            return pd.DataFrame({"word": list(held), "n": list(held.values())})

        for frame in frames:
            for data in frame["data"]:
                held.update(words_of(data))
                if len(held) > HELD:
                    yield out()
                    held.clear()
            held[END] += len(frame)
        if held:
            yield out()

    return texts.select("data").mapInPandas(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """(piece): the texts as 16-bit numbers, ends around each; len(words) is any other word, len(words) + 1 the end.
    Pieces share one token, so that no pair of neighbours is lost."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, other = {w: k for k, w in enumerate(words)}.get, len(words)
        held = [other + 1]
        for frame in frames:
            out = []
            for data in frame["data"]:
                held += [find(w, other) for w in words_of(data)]
                held.append(other + 1)
                if len(held) > PIECE:
                    flat = np.array(held, dtype="<u2")
                    out += [flat[k:k + PIECE + 1].tobytes() for k in range(0, len(flat) - 1, PIECE)]
                    held = held[-1:]
            if out:
                yield pd.DataFrame({"piece": out})
        if len(held) > 1:
            flat = np.array(held, dtype="<u2")
            yield pd.DataFrame({"piece": [flat[k:k + PIECE + 1].tobytes() for k in range(0, len(flat) - 1, PIECE)]})

    return texts.select("data").mapInPandas(work, "piece binary")


def neighbours(pieces: DataFrame, classes: np.ndarray, width: int) -> np.ndarray:
    """words x 2 x width: how often each numbered word has a class before it and behind it."""
    n = len(classes)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, n * width), dtype=np.int64)
        for frame in frames:
            flat = [np.frombuffer(p, dtype="<u2").astype(np.int64) for p in frame["piece"]]
            for k in range(0, len(flat), 64):
                before = np.concatenate([f[:-1] for f in flat[k:k + 64]])
                after = np.concatenate([f[1:] for f in flat[k:k + 64]])
                total[0] += np.bincount(after * width + classes[before], minlength=n * width)
                total[1] += np.bincount(before * width + classes[after], minlength=n * width)
        yield from _rows(total.reshape(2, n, width).transpose(1, 0, 2).reshape(n, -1))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, 2 * width), dtype=np.int64)
        for frame in frames:
            if len(frame):
                np.add.at(total, frame["word"].to_numpy(), np.frombuffer(b"".join(frame["counts"]), dtype="<i8").reshape(-1, 2 * width))
        yield from _rows(total)

    out = np.zeros((n, 2 * width), dtype=np.int64)
    for row in pieces.mapInPandas(count, "word int, counts binary").repartition("word").mapInPandas(add, "word int, counts binary").toLocalIterator():
        out[row["word"]] = np.frombuffer(row["counts"], dtype="<i8")
    return out.reshape(n, 2, width)


def _rows(counts: np.ndarray) -> Iterator[pd.DataFrame]:
    held = np.flatnonzero(counts.any(axis=1))
    yield pd.DataFrame({"word": held, "counts": [counts[k].astype("<i8").tobytes() for k in held]})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def class_pairs(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class bigrams, from every word's classes before it."""
    out = np.zeros((counts.shape[2], counts.shape[2]))
    np.add.at(out.T, classes, counts[:, 0].astype(float))
    return out


def exchange(counts: np.ndarray, classes: np.ndarray, n_classes: int, moving: np.ndarray) -> np.ndarray:
    """The classes after the ``moving`` words went, one after the other, where the class bigrams' likelihood is greatest."""
    classes, pairs = classes.copy(), class_pairs(counts, classes)
    size = np.bincount(classes, weights=counts[:, 0].sum(axis=1), minlength=counts.shape[2])
    for w in moving:
        before, behind = counts[w].astype(float)
        own, n = classes[w], before.sum()
        pairs[:, own] -= before
        pairs[own] -= behind
        size[own] -= n
        # Stale neighbours may take more out of a cell than it holds.
        np.maximum(pairs, 0, out=pairs)
        x, y = np.flatnonzero(before), np.flatnonzero(behind)
        into, from_ = pairs[x, :n_classes], pairs[:n_classes, y]
        gain = ((_xlogx(into + before[x, None]) - _xlogx(into)).sum(axis=0) + (_xlogx(from_ + behind[y]) - _xlogx(from_)).sum(axis=1)
                - 2 * (_xlogx(size[:n_classes] + n) - _xlogx(size[:n_classes])))
        best = int(gain.argmax())
        best = best if gain[best] > gain[own] + 1e-9 else own
        pairs[:, best] += before
        pairs[best] += behind
        size[best] += n
        classes[w] = best
    return classes


def clustered(texts: DataFrame, words: list[bytes], n_classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words (then of any other word, and of the end), and the class bigrams."""
    pieces = stored(numbered(texts, words))
    classes = np.append(np.arange(len(words)) % n_classes, [n_classes, n_classes + 1])
    for k in range(rounds):
        counts = neighbours(pieces, classes, n_classes + 2)
        classes = exchange(counts, classes, n_classes, np.arange(len(words)) if k == 0 else np.arange(k % 2, len(words), 2))
    return classes, class_pairs(neighbours(pieces, classes, n_classes + 2), classes)


def contexts(texts: DataFrame, words: list[bytes], classes: np.ndarray) -> DataFrame:
    """(word, pairs): for words not among ``words`` the classes before and behind each occurrence, two bytes each."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, other = {w: k for k, w in enumerate(words)}.get, len(words)
        held, near = [], []
        code = classes.astype(np.uint8)

        def out():
            found, distinct = pd.factorize(np.array(held, dtype=object))
            # Occurrences in order of their word; each word takes its stretch.
            data = np.concatenate(near)[np.argsort(found, kind="stable")].tobytes()
            ends = (2 * np.cumsum(np.bincount(found))).tolist()
            return pd.DataFrame({"word": distinct, "pairs": [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]})

        for frame in frames:
            for data in frame["data"]:
                given = words_of(data)
                ids = np.array([other + 1, *[find(w, other) for w in given], other + 1])
                of, at = code[ids], np.flatnonzero(ids == other)
                near.append(np.stack((of[at - 1], of[at + 1]), axis=1))
                held += [given[k - 1] for k in at.tolist()]
                if len(held) > HELD * 4:
                    yield out()
                    held, near = [], []
        if held:
            yield out()

    return texts.select("data").mapInPandas(work, "word binary, pairs binary")


def moved(pairs: DataFrame, bigrams: np.ndarray, n_classes: int) -> DataFrame:
    """(word, n, class): each word in the class that the classes around it favour most, all against the same counts.

    Partitions are sorted by word. Only counts are held, a word's row at a time where it spans batches.
    """
    width = n_classes + 2
    logs, sizes = np.log(bigrams + 0.5), np.log(bigrams.sum(axis=0)[:n_classes] + 1)
    gains = np.vstack((logs[:, :n_classes], logs[:n_classes].T))

    def placed(found: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        n = counts[:, :width].sum(axis=1)
        return pd.DataFrame({"word": found, "n": n, "class": (counts @ gains - 2 * n[:, None] * sizes).argmax(axis=1)})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for frame in frames:
            for k in range(0, len(frame), 2048):
                part = frame["word"].iloc[k:k + 2048].to_numpy()
                new = np.append(True, part[1:] != part[:-1])
                found, index = part[new], np.cumsum(new) - 1
                data = frame["pairs"].iloc[k:k + 2048]
                row = np.repeat(index, [len(p) // 2 for p in data])
                near = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, 2).astype(np.int64)
                counts = np.zeros((len(found), 2 * width), dtype=np.int64)
                np.add.at(counts, (row, near[:, 0]), 1)
                np.add.at(counts, (row, near[:, 1] + width), 1)
                if last is not None and last == found[0]:
                    counts[0] += kept
                elif last is not None:
                    yield placed(np.array([last], dtype=object), kept[None])
                last, kept = found[-1], counts[-1]
                if len(found) > 1:
                    yield placed(found[:-1], counts[:-1])
        if last is not None:
            yield placed(np.array([last], dtype=object), kept[None])

    return pairs.repartition("word").sortWithinPartitions("word").mapInPandas(work, "word binary, n long, class int")


@dataclass
class Model:
    """What scoring needs beside the vocabulary: totals, and by class tokens and distinct words; the end is the last class."""
    tokens: int
    types: int
    ones: int
    twos: int
    sizes: np.ndarray
    members: np.ndarray
    pairs: np.ndarray | None = None

    @property
    def discount(self) -> float:
        return (self.ones + 1) / (self.ones + 1 + 2 * (self.twos + 1))

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + self.types + 1))

    def emission(self, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a seen word's share in its class; the end is alone in its own."""
        alone = classes == len(self.sizes) - 1
        return np.log10(np.where(alone, 1.0, (n - self.discount) / np.maximum(self.sizes[classes], 1)))

    def transitions(self) -> np.ndarray:
        """log10 of each class's probability after each."""
        shares = self.sizes / max(self.tokens, 1)
        pull = len(self.sizes)
        return np.log10(np.maximum((self.pairs + pull * shares) / (self.pairs.sum(axis=1)[:, None] + pull), 1e-300))

    def unseen(self) -> tuple[np.ndarray, np.ndarray]:
        """By the class before: an unseen word's class and log10 probability, transition included."""
        kinds = self.ones ** 2 / (2 * self.twos + 1) + 1
        given_up = self.discount * self.members[:-1] / np.maximum(self.sizes[:-1], 1) / kinds
        odds = 10.0 ** self.transitions()[:, :-1] * given_up
        least = 1 / (self.tokens + self.types + 1)
        top = odds.max(axis=1, initial=0.0)
        return odds.argmax(axis=1), np.log10(np.where(top > 0, top, least))


def encoded(texts: DataFrame, words: list[bytes], counts: np.ndarray, classes: np.ndarray, model: Model) -> DataFrame:
    """(row, id, learn, n, known, base, emission, code, lacked): each text's bytes and sums over the words of the table, and
    the words that the table lacks, in order."""
    from pyspark import TaskContext

    table, end = b"\n".join(words), len(model.sizes) - 1
    code = np.append(classes, [OPEN, end]).astype(np.uint8)
    base = np.append(model.base(counts), [0.0, 0.0])
    emission = np.append(model.emission(counts, classes), [0.0, 0.0])
    id_kind = texts.schema["id"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = {w: k for k, w in enumerate(table.split(b"\n"))}.get if words else {}.get
        other, row = len(words), TaskContext.get().partitionId() << 33
        for frame in frames:
            out = []
            for id_, learn, data in zip(frame["id"], frame["learn"], frame["data"], strict=True):
                given = words_of(data)
                ids = np.array([*[find(w, other) for w in given], other + 1])
                lacked = [given[k] for k in np.flatnonzero(ids == other).tolist()]
                out.append((row, id_, learn, len(ids), len(given) - len(lacked), base[ids].sum(), emission[ids].sum(), code[ids].tobytes(), lacked))
                row += 1
            yield pd.DataFrame(out, columns=names, dtype=object)

    kind = f"row long, id {id_kind}, learn boolean, n int, known int, base double, emission double, code binary, lacked array<binary>"
    names = [c.split()[0] for c in kind.split(", ")]
    return texts.mapInPandas(work, kind)


def filled(texts: DataFrame, looked: DataFrame, model: Model) -> DataFrame:
    """The texts with the looked-up words' classes, counts and sums; words that no text taught stay open."""
    found = looked.groupBy("row").agg(*[F.collect_list(c).alias(c) for c in ("place", "m", "class")])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for id_, learn, n, known, base, emission, code, place, m, cls in zip(*[frame[c] for c in frame.columns], strict=True):
                if place is not None and len(place):
                    m, cls = np.asarray(m), np.asarray(cls)
                    seen = m > 0
                    code = np.frombuffer(code, dtype=np.uint8).copy()
                    code[np.flatnonzero(code == OPEN)[np.asarray(place)]] = np.where(seen, cls, OPEN)
                    known += int(seen.sum())
                    base += float(model.base(m).sum())
                    emission += float(model.emission(m[seen], cls[seen]).sum())
                    code = code.tobytes()
                out.append((id_, learn, n, known, base, emission, code))
            yield pd.DataFrame(out, columns=names, dtype=object)

    kind = f"id {texts.schema['id'].dataType.simpleString()}, learn boolean, n int, known int, base double, emission double, code binary"
    names = [c.split()[0] for c in kind.split(", ")]
    return texts.join(found, "row", "left").select(*names, "place", "m", "class").mapInPandas(work, kind)


def transitions(codes: DataFrame, n: int) -> np.ndarray:
    """n x n class bigrams over the texts that may be learned from."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n * n, dtype=np.int64)
        for frame in frames:
            for code in frame["code"]:
                c = np.frombuffer(code, dtype=np.uint8).astype(np.int64)
                np.add.at(total, np.append(n - 1, c[:-1]) * n + c, 1) if len(c) < 64 else np.add(
                    total, np.bincount(np.append(n - 1, c[:-1]) * n + c, minlength=n * n), out=total)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"pair": held, "n": total[held]})

    out = np.zeros(n * n)
    for r in codes.filter("learn").select("code").mapInPandas(work, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(n, n)


def scorer(model: Model) -> Callable[[bytes], float]:
    """The log10 probability of a text's classes, and of its unseen words."""
    step, (open_class, open_log), end = model.transitions(), model.unseen(), len(model.sizes) - 1

    def score(code: bytes) -> float:
        c = np.frombuffer(code, dtype=np.uint8).astype(np.int64)
        open_ = np.flatnonzero(c == OPEN)
        if not len(open_):
            return float(step[np.append(end, c[:-1]), c].sum())
        for k in open_.tolist():
            c[k] = open_class[c[k - 1] if k else end]
        before = np.append(end, c[:-1])
        logs = step[before, c]
        logs[open_] = open_log[before[open_]]
        return float(logs.sum())

    return score


def score(docs: DataFrame, may_learn: Column, n_classes: int = CLASSES, rounds: int = ROUNDS, exchanged: int = EXCHANGED,
          table: int = TABLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row. ``base_score``
    is the add-one unigram's log10 probability, ``perplexity`` that of the score."""
    if not 0 < n_classes <= 250 or not 0 < exchanged < 65_534:
        raise ValueError("classes must fit a byte and exchanged words sixteen bits")
    slim_bytes(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(may_learn, F.lit(False)).alias("learn"), whole_text(text_col).cast("binary").alias("data"))
    learned = texts.filter("learn")
    vocabulary = stored(count_words(learned))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types"),
                           F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).first()
    top = _top(vocabulary.filter(F.col("word") != F.lit(END)), exchanged)
    words = [bytes(r["word"]) for r in top]
    classes, bigrams = clustered(learned, words, n_classes, rounds)
    rest = stored(moved(contexts(learned, words, classes), bigrams, n_classes))
    counts = np.array([r["n"] for r in top], dtype=np.int64)
    ends = total["tokens"] - int(counts.sum()) - (rest.agg(F.sum("n")).first()[0] or 0)
    model = Model(total["tokens"], total["types"], total["ones"], total["twos"], np.zeros(n_classes + 1), np.zeros(n_classes + 1, dtype=np.int64))
    model.sizes[:] = np.bincount(classes[:-2], weights=counts, minlength=n_classes + 1)
    model.members[:] = np.bincount(classes[:-2], minlength=n_classes + 1)
    for r in rest.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        model.sizes[r["class"]] += r["n"]
        model.members[r["class"]] += r["words"]
    model.sizes[-1], model.members[-1] = ends, 1
    more = _top(rest, max(table - len(words), 0))
    known = stored(encoded(texts, words + [bytes(r["word"]) for r in more], np.append(counts, [r["n"] for r in more]).astype(np.int64),
                           np.append(classes[:-2], [r["class"] for r in more]).astype(np.int64), model))
    looked = known.select("row", F.posexplode("lacked").alias("place", "word")).join(rest, "word", "left").select(
        "row", "place", F.coalesce("n", F.lit(0)).alias("m"), F.coalesce("class", F.lit(0)).alias("class"))
    codes = stored(filled(known.drop("lacked"), looked, model))
    model.pairs = transitions(codes, n_classes + 1)
    end_base = float(model.base(np.array([ends]))[0])

    @F.pandas_udf("double")
    def likely(codes: pd.Series) -> pd.Series:
        of = scorer(model)
        return pd.Series([of(c) for c in codes], dtype=float)

    # The end is known wherever anything was learned.
    base = F.col("base") + F.lit(end_base)
    scored = (F.col("emission") + likely("code")) if total["tokens"] else base
    return codes.withColumns({"base": base, "s": scored}).select(
        F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), F.col("n").cast("long").alias("n_tokens"),
        (F.col("known") + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(total["tokens"]).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("s").alias("score"), F.pow(F.lit(10.0), -F.col("s") / F.col("n")).alias("perplexity"))


def _top(words: DataFrame, n: int) -> list:
    """The most frequent words, in whole steps of the scale, at most ``n``; by falling count and rising word."""
    step = F.floor(F.log2("n") * 64)
    left, least = n, None
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("step").desc()).collect():
        left -= r["words"]
        if left < 0:
            break
        least = r["step"]
    rows = [] if least is None else words.filter(step >= least).collect()
    return sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))
