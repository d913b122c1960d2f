"""Toxicity by weak supervision.

Many voters look at a text: one for each lexicon term and some for patterns (terms spelled with digits, letters spaced
out, shouted or addressed terms, texts that hold no term at all). A generative label model turns their votes into
posterior labels, and a linear classifier trained on those scores every text.

Terms are words and word beginnings (a trailing * means any ending), picked from a bounded labelled sample together with
a stated list of common insults. The label model knows, for every two voters, how often they vote together over all
documents. If voters erred independently, the covariance of voters i and j would be pi (1 - pi) d_i d_j, where pi is the
share of toxic texts and d_i tells how much more often i votes on toxic ones. The d are fitted to all pairs, starting at
the labelled sample and leaving out pairs that the fit shows to be correlated; a voter that repeats others weighs less.

Bounds, all of them parameters: ``per_label`` labelled texts of each label for the terms, ``fitted`` of them for the
models; ``terms`` lexicon voters. Everything else
reads whole texts and all documents. Null and empty texts get the score of a text without any vote. Without labelled
rows every text scores 0.

Texts of any length are read whole; a score of just 0.5 is toxic; equal rows get equal scores; other columns may have
any name.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import rows_frame, slim_batches, whole_text
from feedloom.llm.encoders import Remembered
from feedloom.llm.linear import logistic_newton
from feedloom.operators.ranking import top_per_key

#: Labelled texts of each label that terms are picked from, and of those the ones that label model and classifier are
#: fitted on; lexicon voters at most.
PER_LABEL, FITTED, TERMS = 20_000, 3000, 96
#: Common insults that vote without having been seen in labelled texts.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting",
           "clown", "jerk", "fool", "bastard", "filth", "freak", "vermin", "retard", "imbecile", "crétin", "connard", "salaud",
           "débile", "dummkopf", "trottel", "arschloch", "vollidiot", "imbécil", "estúpido", "estúpida", "basura", "cabrón")
#: Digits and signs that stand for letters.
SPELLED = str.maketrans("013457@$!", "oieastasi")
#: Forms of address.
ADDRESS = ("you", "your", "du", "ihr", "tu", "vous", "tú", "usted")
#: Lengths of word beginnings that may be terms, and buckets of the words that are none.
BEGINNINGS, BUCKETS = (4, 5, 6), 1 << 9
#: Words a worker remembers per generation.
KNOWN_WORDS = 200_000
PATTERNS = ("spelled", "spaced", "shouted", "addressed", "several", "none")

_WORD = re.compile(r"[^\W\d_]+")
_SPELT = re.compile(r"[^\W_]*[013457@$!][^\W_][\w@$!]*")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-*_]){3,}\w(?!\w)")


def terms_of(word: str) -> list[str]:
    """What a word may match: itself, and its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def term_counts(sample: DataFrame) -> pd.DataFrame:
    """(term, toxic, clean): how many sampled texts of each label hold a term; terms of fewer than three texts go."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                counts[label].update({t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)})
        terms = list(counts[0].keys() | counts[1].keys())
        yield rows_frame([(t, counts[1][t], counts[0][t]) for t in terms], ("term", "toxic", "clean"))

    return sample.mapInPandas(work, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic >= 3").orderBy(
        (F.col("toxic") / (F.col("toxic") + 4 * F.col("clean") + 2)).desc(), F.desc("toxic"), "term").limit(20_000).toPandas()


def pick_terms(counts: pd.DataFrame, toxic: int, clean: int, limit: int) -> list[str]:
    """Terms that toxic texts hold far more often than clean ones. A term that another one implies is left out: of those
    that cover each other the one in most texts stays, and the longer of two beginnings in the same texts."""
    if not toxic or not len(counts):
        return []
    share = (counts["toxic"] + 0.1) / (toxic + 1)
    odds = share / ((counts["clean"] + 0.1) / (clean + 1))
    # A few copies of one text must not make its rare words terms.
    good = counts[(odds >= 100) & (counts["toxic"] >= max(5, 0.01 * toxic))].assign(size=lambda d: d["term"].str.len())
    good = good.sort_values(["toxic", "size", "term"], ascending=[False, False, True])
    picked: list[str] = []
    for term in good["term"]:
        stem = term.rstrip("*")
        if not any(p == stem or (p[-1] == "*" and stem.startswith(p[:-1])) or (term[-1] == "*" and p.rstrip("*").startswith(stem))
                   for p in picked):
            picked.append(term)
        if len(picked) == limit:
            break
    return picked


class Voters:
    """Votes of all voters on a text: 1 for toxic, -1 for clean, 0 for none."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.place = {t: k for k, t in enumerate(terms)}
        self.names = [*terms, *PATTERNS]
        self.hits = Remembered(lambda w: tuple(self.place[t] for t in terms_of(w) if t in self.place), KNOWN_WORDS)

    def hit(self, word: str) -> tuple[int, ...]:
        return self.hits[word]

    def __call__(self, text: str) -> tuple[np.ndarray, set[str]]:
        words = _WORD.findall(text)
        lower = set(map(str.lower, words))
        vote = np.zeros(len(self.names), dtype=np.int8)
        for w in lower:
            for k in self.hits[w]:
                vote[k] = 1
        found = int(vote.sum())
        at = len(self.terms)
        marks = [x.lower() for x in _SPELT.findall(text)] if any(c in text for c in "013457@$!") else []
        vote[at] = any(self._term(m.translate(SPELLED)) and not self._term(m) for m in marks)
        vote[at + 1] = any(self._term(re.sub(r"[\W_]", "", m).lower()) for m in _SPACED.findall(text))
        if found:
            vote[at + 2] = any(w.isupper() and len(w) > 2 and self.hits[w.lower()] for w in words)
            vote[at + 3] = bool(lower & set(ADDRESS))
            vote[at + 4] = found > 1
        vote[at + 5] = 0 if vote.any() else -1
        return vote, lower

    def _term(self, word: str) -> bool:
        return any(self.hits[p] for p in _WORD.findall(word)) if word else False


def vote_moments(texts: DataFrame, voters: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Documents, sums of votes and sums of products of two votes, over all documents: a table of voters by voters."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = Voters(voters)
        n, size = 0, len(ask.names)
        total, both = np.zeros(size), np.zeros((size, size))
        for frame in frames:
            for at in range(0, len(frame), 512):
                votes = np.stack([ask(t)[0] for t in frame["text"].iloc[at:at + 512]]).astype(np.float64)
                n, total, both = n + len(votes), total + votes.sum(axis=0), both + votes.T @ votes
        if n:
            yield pd.DataFrame({"i": np.arange(size + 1), "v": [[float(n), *total], *([0.0, *row] for row in both)]})

    size = len(voters) + len(PATTERNS)
    rows = texts.mapInPandas(work, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(
        F.sum("v").alias("v")).toPandas()  # one number for each pair of voters
    table = np.zeros((size + 1, size + 1))
    table[rows["i"], rows["j"]] = rows["v"]
    return int(table[0, 0]), table[0, 1:], table[1:, 1:]


@dataclass
class LabelModel:
    prior: float
    yes: np.ndarray  # chance of each voter's vote on a toxic text
    no: np.ndarray  # and on a clean one
    overlap: np.ndarray  # how far two voters repeat each other, from 0 to 1

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a text is toxic, from its votes. A vote weighs less by what other votes on the text repeat of it;
        silence weighs less by what all voters repeat."""
        cast = (votes != 0).astype(np.float64)
        spoke, silent = np.log(self.yes / self.no), np.log((1 - self.yes) / (1 - self.no))
        total = np.log(self.prior / (1 - self.prior)) + (cast / (1 + cast @ self.overlap)) @ spoke
        total += (1 - cast) @ (silent / (1 + self.overlap.sum(axis=1)))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_label_model(moments: tuple, votes: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 50,
                    anchor: float = 5.0) -> LabelModel:
    """Accuracies and correlations of the voters."""
    n, total, both = moments
    cast = np.abs(votes).astype(np.float64)
    sign = np.where(total < 0, -1.0, 1.0)
    rate = np.abs(total) / n  # every voter has one kind of vote
    cov = both / n * np.outer(sign, sign) - np.outer(rate, rate)
    seen_yes = (cast[labels == 1].sum(axis=0) + 0.1) / ((labels == 1).sum() + 1)
    seen_no = (cast[labels == 0].sum(axis=0) + 0.1) / ((labels == 0).sum() + 1)
    start = seen_yes - seen_no
    spread = prior * (1 - prior)
    scale = np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate))) + 1e-12
    d, free = start.copy(), ~np.eye(len(rate), dtype=bool)
    for k in range(rounds):
        left = cov - spread * np.outer(d, d)
        if k % 10 == 0:  # pairs that stand out are correlated for another reason than the label
            free = ~np.eye(len(rate), dtype=bool) & (np.abs(left / scale) < 0.1)
        target = np.where(free, cov / spread, 0.0)
        d = (target @ d + anchor * start) / ((free * d ** 2).sum(axis=1) + anchor)
    left = np.clip((cov - spread * np.outer(d, d)) / scale, 0, 1) * ~np.eye(len(rate), dtype=bool)
    overlap = np.where(left >= 0.1, left, 0.0)
    low, high = 0.5 / (n + 1), 1 - 0.5 / (n + 1)
    return LabelModel(prior, np.clip(rate + (1 - prior) * d, low, high), np.clip(rate - prior * d, low, high), overlap)


class Features:
    """Votes, and the share of a text's distinct words in each hash bucket."""

    def __init__(self, terms: list[str]):
        self.ask = Voters(terms)
        self.bucket = Remembered(hash_word, KNOWN_WORDS)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        vote, words = self.ask(text)
        buckets = np.fromiter(map(self.bucket.__getitem__, words), dtype=np.int64, count=len(words))
        return vote, buckets


def hash_word(word: str) -> int:
    """A bucket for a word's beginning; stable over processes."""
    value = 0
    for b in word[:6].encode("utf-8", "replace"):
        value = (value * 31 + b) & 0xFFFFFFFF
    return ((value * 0x9E3779B1) & 0xFFFFFFFF) % BUCKETS


def dense(votes: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(buckets), votes.shape[1] + BUCKETS), dtype=np.float32)
    out[:, :votes.shape[1]] = votes
    for k, b in enumerate(buckets):
        if len(b):
            out[k, votes.shape[1]:] = np.bincount(b, minlength=BUCKETS) / np.sqrt(len(b) ** 2 + 1.0)
    return out


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray

    def scores(self, votes: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
        size = votes.shape[1]
        total = votes.astype(np.float64) @ self.weights[:size] + self.weights[-1]
        own = self.weights[size:-1]
        total += np.array([own[b].sum() / np.sqrt(len(b) ** 2 + 1.0) if len(b) else 0.0 for b in buckets])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_label: int, fitted: int, terms: int, id_col: str, text_col: str, label_col: str) -> Model | None:
    """Lexicon, label model and classifier; None where no document has a label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_label in (0, 1)")
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if not counts:
        return None
    wanted = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    # A bounded sample: ``per_label`` ids of either label.
    ids = top_per_key(wanted.select(F.col("_id").alias("id"), F.col("_label").alias("label"), F.xxhash64("_id").alias("h"))
                      .filter("id is not null"), ["label"], [F.col("h"), F.col("id")], per_label, ["h"])
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(ids), "id").select(
        "text", "label", "rank")
    sampled = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    lexicon = pick_terms(term_counts(texts), sampled.get(1, 0), sampled.get(0, 0), terms)
    covered = Voters(lexicon)
    lexicon += [w for w in INSULTS if not covered.hit(w)]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features(lexicon)
        for frame in frames:
            rows = [make(t) for t in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "vote": [v.tobytes() for v, _ in rows], "bucket": [b.tobytes() for _, b in rows]})

    rows = texts.filter(F.col("rank") <= fitted).mapInPandas(look, "label int, vote binary, bucket binary").toPandas().sort_values(["label", "vote", "bucket"])
    if rows.empty:
        return None
    votes = np.frombuffer(b"".join(rows["vote"]), dtype=np.int8).reshape(len(rows), -1)
    label = rows["label"].to_numpy()
    prior = float(np.clip(counts.get(1, 0) / sum(counts.values()), 1e-4, 1 - 1e-4))
    moments = vote_moments(docs.select(whole_text(text_col).alias("text")), lexicon)
    believed = fit_label_model(moments, votes, label, prior).posterior(votes)
    # The sample has as many texts of either label as it can; weights bring back their real shares.
    weight = np.where(label == 1, prior / max(1, (label == 1).sum()), (1 - prior) / max(1, (label == 0).sum()))
    x = dense(votes, [np.frombuffer(b, dtype=np.int64) for b in rows["bucket"]])
    return Model(lexicon, logistic_newton(x, believed, weight))


def score(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, fitted: int = FITTED, terms: int = TERMS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted. ``labels`` holds only rows that may be learned from."""
    slim_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_label, fitted, terms, id_col, text_col, label_col))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        make = Features(model.terms) if model else None
        for texts in batches:
            if model is None or not len(texts):
                yield pd.Series(np.zeros(len(texts)))
                continue
            rows = [make(t) for t in texts]
            yield pd.Series(model.scores(np.stack([v for v, _ in rows]), [b for _, b in rows]))

    found = docs.withColumn("__score", scored(whole_text(text_col)))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")), F.col("__score").alias("score"),
                        (F.col("__score") >= 0.5).cast("int").alias("predicted"))
