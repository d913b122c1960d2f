"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams predicts whether a text
has it. A text's language is the codeword with the least weighted loss over all bits, where a bit weighs as much as its
classifier proved right; where the best codeword is not clearly nearer than the others, the text is flagged ambiguous.

The classifiers are fitted on a bounded sample: the ``per_language`` texts of each language whose ids hash lowest, among
rows that may be learned from. Prediction reads whole texts and nothing else.

Texts that are null or have no letter are ``und`` with score 0 and not ambiguous. Without any language to learn every
text is ``und``; with one, every text with a letter is that language, with score 1. Rows that repeat an id are predicted
each on its own.

Long texts are read whole, and other columns may have any name. Codewords at equal loss: the first in the order of
languages counts.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import slim_batches
from feedloom.llm.linear import logistic, sample_by

#: Texts of each language that the classifiers are fitted on.
PER_LANGUAGE = 600
#: Hash buckets of the n-grams, as a power of two, and the lengths in bytes.
BUCKET_BITS, LENGTHS = 12, (1, 2, 3, 4)
#: A text is ambiguous where the best codeword is less than this many times as likely as the second.
LEAD = 1.1
#: Long texts are counted in pieces of this many bytes.
PIECE = 1 << 20

_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
_FACTORS = {1: 0x9E3779B1, 2: 0x85EBCA6B, 3: 0xC2B2AE35, 4: 0x27D4EB2F}


def features(text: str) -> np.ndarray:
    """Square roots of the shares of a text's hashed byte n-grams; digits and marks count as space."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    total = np.zeros(1 << BUCKET_BITS, dtype=np.float64)
    shift = np.uint32(32 - BUCKET_BITS)
    for at in range(0, len(data), PIECE):
        raw = np.frombuffer(data[at:at + PIECE + max(LENGTHS) - 1], dtype=np.uint8).astype(np.uint32)
        size = min(PIECE, len(data) - at)
        gram = np.zeros(len(raw), dtype=np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            gram = (gram[:len(raw) - n + 1] << np.uint32(8)) | raw[n - 1:]
            if n in LENGTHS:
                total += np.bincount((gram[:size] * np.uint32(_FACTORS[n])) >> shift, minlength=len(total))
    return np.sqrt(total / max(1.0, total.sum())).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 per language. Up to five languages get all ways to part them in two; more get about ten bits per
    doubling, drawn by a fixed seed, without columns that are alike up to sign."""
    if languages <= 5:
        columns = [[1 if (k >> row) & 1 else -1 for row in range(languages)] for k in range(1, 1 << (languages - 1))]
        return np.array(columns, dtype=np.float32).T.reshape(languages, -1)
    rng, columns = np.random.default_rng(6), {}
    while len(columns) < int(10 * np.ceil(np.log2(languages))):
        c = rng.choice([-1, 1], languages)
        if abs(c.sum()) < languages:
            columns[tuple(c * c[0])] = c
    return np.array(list(columns.values()), dtype=np.float32).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of features the index of the nearest codeword, its share of the likelihood, and its lead: how many
        times as likely as the second it is."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * c)).sum(axis=1) for c in self.code], axis=1)
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        second = np.partition(near, -2, axis=1)[:, -2]
        return loss.argmin(axis=1), 1 / near.sum(axis=1), 1 / np.maximum(second, 1e-300)


def fit(docs: DataFrame, may_learn: Column, per_language: int, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """Fit the classifiers on a bounded sample; None where no row names a language."""
    chosen = sample_by(docs, F.when(may_learn, F.col(lang_col)), per_language, id_col, text_col)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"].astype(str), "label": frame["label"],
                                "x": [features(t).tobytes() for t in frame["text"]]})

    rows = chosen.select(F.col("id").cast("string").alias("id"), "label", "text").mapInPandas(
        work, "id string, label string, x binary").toPandas().sort_values(["label", "id"])
    if rows.empty:
        return None
    languages = sorted(rows["label"].unique())
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), -1)
    code = codewords(len(languages))
    if not code.shape[1]:
        return Model(languages, code, np.zeros((x.shape[1] + 1, 0), dtype=np.float32), np.zeros(0))
    which = rows["label"].map({v: k for k, v in enumerate(languages)}).to_numpy()
    weight = 1 / np.bincount(which)[which]
    bits = (code[which] + 1) / 2
    weights = logistic(x, bits, weight, ridge=1e-5, rounds=300)
    right = (((x @ weights[:-1] + weights[-1]) > 0) == (bits > 0.5)).mean(axis=0)
    trust = np.log((right * len(x) + 1) / ((1 - right) * len(x) + 1))
    return Model(languages, code, weights, np.maximum(trust, 0.01) / max(trust.mean(), 0.01))


def identify(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    slim_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, may_learn, per_language, id_col, text_col, lang_col))

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model, out = sent.value, []
        for at in range(0, len(texts), 256):
            part = texts.iloc[at:at + 256]
            known = [t is not None and model is not None and any(map(str.isalpha, t)) for t in part]
            if any(known):
                many = sum(known)
                found = zip(*(model.decode(np.stack([features(t) for t, k in zip(part, known, strict=True) if k]))
                              if len(model.languages) > 1 else (np.zeros(many, int), np.ones(many), np.full(many, np.inf))), strict=True)
            for k in known:
                if k:
                    best, share, lead = next(found)
                    out.append((model.languages[best], float(share), bool(lead < LEAD)))
                else:
                    out.append(("und", 0.0, False))
        return pd.DataFrame(out, columns=["lang", "score", "ambiguous"])

    # Columns of the input that have the results' names give way to them.
    found = docs.withColumn("__found", predict(F.col(text_col)))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")),
                        F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"),
                        F.col("__found.ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame, may_learn: Column, **how) -> DataFrame:
    """The rows whose language is told, neither ``und`` nor ambiguous, with all their columns."""
    own = {c: f"_own_{c}" for c in ("lang_pred", "score", "ambiguous") if c in docs.columns}
    told = identify(docs.withColumnsRenamed(own), may_learn, **how).filter("lang_pred <> 'und' and not ambiguous")
    return told.drop("lang_pred", "score", "ambiguous").withColumnsRenamed({v: k for k, v in own.items()}).select(
        *(F.col(f"`{c}`") for c in docs.columns))
