"""Helpers shared by the corpus operators: texts, folds, hashed words, whole groups of a sorted partition."""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Odd multipliers and the finaliser's constants of splitmix64 (fixed values).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Base of the word hash; odd, so that it can be inverted modulo 2**64.
BASE = np.uint64(0x100000001B3)
BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Texts are hashed in pieces of this many bytes, which bounds the arrays held at once.
PIECE = 1 << 19


def whole_text(name: str = "text") -> Column:
    """The text column; null reads as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(name: str, folds: int) -> Column:
    """CRC32 of the id's decimal digits, modulo ``folds``; an id that is null falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def slim_batches(spark, rows: int = 512):
    """Arrow batches of fewer rows, so that a batch of long texts stays small in a Python worker. Spark reads the setting
    when the job runs, so it stays in the session; a smaller one is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slim_bytes(spark, mb: int = 8):
    """Arrow batches of fewer bytes, whatever their rows; a smaller setting is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(spark.conf.get(key)).strip().lower().rstrip("b")
    size = int(held[:-1]) * {"k": 1, "m": 1 << 10, "g": 1 << 20}[held[-1]] << 10 if held[-1:] in "kmg" else int(held)
    if not 0 < size <= mb << 20:
        spark.conf.set(key, f"{mb}m")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words of single-spaced UTF-8 bytes, without a Python loop over words."""

    def __init__(self, piece: int = PIECE):
        self.piece = piece
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, data: bytes) -> np.ndarray:
        if not data:
            return np.empty(0, dtype=np.uint64)
        out, at = [], 0
        while at < len(data):
            end = len(data) if len(data) - at <= self.piece else data.find(b" ", at + self.piece)
            end = len(data) if end < 0 else end
            out.append(self._piece(data[at:end]))
            at = end + 1
        return np.concatenate(out)

    def _piece(self, data: bytes) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            self.up, self.down = _powers(BASE, len(data) + 1), _powers(BASE_INVERSE, len(data) + 1)
        raw = np.frombuffer(data, dtype=np.uint8)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64, out=total[1:])
        gaps = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
        return mix64((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


def whole_groups(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup the batches of a partition sorted by ``keys`` so that no group is cut: a batch's last group waits for the
    next batch. Only one batch and one group are held."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = np.ones(len(frame), dtype=bool)
        for k in keys:
            last &= (frame[k] == frame[k].iloc[-1]).to_numpy()
        if last.all() and kept and all((kept[-1][k].iloc[-1] == frame[k].iloc[-1]) for k in keys):
            kept.append(frame)
            continue
        cut = len(frame) - int(last[::-1].argmin()) if not last.all() else 0
        done = [*kept, frame.iloc[:cut]]
        kept = [frame.iloc[cut:]]
        done = [d for d in done if len(d)]
        if done:
            yield pd.concat(done, ignore_index=True)
    if kept:
        yield pd.concat(kept, ignore_index=True)


def group_bounds(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Where each run of equal keys begins, with the length of the frame at the end."""
    new = np.zeros(len(frame), dtype=bool)
    new[:1] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def rows_frame(rows: list[tuple], columns: Sequence[str]) -> pd.DataFrame:
    """A frame of plain objects: no column is guessed to be a number or to lie in several chunks of text."""
    return pd.DataFrame(rows, columns=list(columns), dtype=object)
