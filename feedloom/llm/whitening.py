"""Embedding whitening by a bidiagonal qd solver.

Components become integers floor(scale * x). The fit list holds each distinct integer vector once: n vectors with sums S.
Every task centres its rows of the list and keeps the triangular factor of a blockwise QR; the factors are stacked and
reduced in a tree of fixed fan-in, so that one triangle R of (dimensions x dimensions) is left with R'R = n times the
covariance. The driver, which holds nothing else, turns R to upper bidiagonal form by Householder reflections, finds
its singular values by dqds (squares, without a subtraction but for the shift), and each right singular vector from the twisted
factorisation of the bidiagonal's product at its value. No covariance matrix is made on the way, so small values keep
their digits. Values too close for one twist to separate are handled by orthogonalising inside their group.

A row of the result is (row, component): deviation is the sum over dimensions of (n x - S)^2, exact (null where a long cannot
hold it), whitened the centred vector projected on the component over the root of its eigenvalue. ``identity_error`` is measured from the
whitened fit list by a job of its own.

Vectors that are null or hold a null or non-finite component take no part, nor do those whose length is not the most
frequent one (ties: the longer), nor empty ones. Components whose eigenvalue is nothing but rounding (below 1e-26 of the greatest) are left
out, as nothing can be divided by them: one vector, or only copies of it, gives no row. Repeated rows come back each, and
count once in the fit; rows with a null id come back with it. Empty tables give no rows. Columns of the table with any
name are left alone. Only ids and vectors are read. The driver's bound is 16 bytes x dimensions^2 and the components.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feedloom.session import stored

#: Triangles that one task stacks, and rows between two reductions inside a task.
FAN_IN, ROWS = 64, 4096
#: Eigenvalues below this share of the greatest are rounding.
RANK = 1e-26
#: Squared singular values closer than this (relative) are orthogonalised against each other.
CLOSE = 1e-3


@dataclass
class Whitening:
    """A fitted whitening: n, the sums, unit components as rows, their eigenvalues, and the covariance's trace."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows."""
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2 for each row; null beyond a long."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if top * top * max(x.shape[1], 1) < 1 << 63 else object
        off = self.n * x.astype(kind) - np.array(self.sums, dtype=kind)
        return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n with one rounding: n x - S is formed in whole numbers."""
    top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if top < 1 << 62 else object
    return (n * x.astype(kind) - np.array(sums, dtype=kind)).astype(float) / n


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x): the vectors that take part, in integers."""
    fine = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = rows.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine).select(F.col(id_col).alias("id"), F.transform(
        vec_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"))
    widths = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return whole.filter(F.size("x") == widths.agg(F.max_by("d", F.struct("n", "d"))).scalar())


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0), dtype=np.int64)


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and their sums by dimension."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, None
        for frame in frames:
            if len(frame):
                part = matrix(frame["x"]).astype(object if frame["x"].map(lambda v: np.abs(v).max()).max() > 1 << 40 else np.int64).sum(axis=0)
                n, sums = n + len(frame), [int(a) + b for a, b in zip(part, sums or [0] * len(part), strict=True)]
        if n:
            yield pd.DataFrame({"k": range(-1, len(sums)), "v": [str(v) for v in (n, *sums)]})

    rows = fit.mapInPandas(work, "k int, v string").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r["k"]: int(r["v"]) for r in rows}
    return found.pop(-1, 0), [found[k] for k in sorted(found)]


def triangle(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """The triangular factor of all rows, block after block."""
    r = None
    for block in blocks:
        if len(block):
            r = np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")
    return r


def _triangles(r: np.ndarray | None, part: int) -> Iterator[pd.DataFrame]:
    if r is not None:
        yield pd.DataFrame({"part": part, "r": list(r)})


def reduced(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """One triangle R with R'R the sum of the outer products of all centred rows."""
    from pyspark import TaskContext

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = (centred(matrix(f["x"].iloc[k:k + ROWS]), n, sums) for f in frames for k in range(0, len(f), ROWS))
        yield from _triangles(triangle(pieces), TaskContext.get().partitionId())

    def stack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_triangles(triangle(iter([matrix(frame["r"])])), int(key[0])))

    kind = "part long, r array<double>"
    rows = stored(fit.mapInPandas(first, kind))
    while rows.agg(F.max("part")).first()[0]:
        rows = stored(rows.groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).applyInPandas(stack, kind))
    d = len(sums)
    left = np.array([row["r"] for row in rows.select("r").collect()]).reshape(-1, d)
    return np.linalg.qr(np.vstack((left, np.zeros((d, d)))), mode="r")


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of B = U'RV, and the reflections whose product is V."""
    a, d = r.copy(), len(r)
    right = []
    for k in range(d):
        v = _reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = _reflection(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflection(x: np.ndarray) -> np.ndarray:
    """The unit vector of the reflection that leaves ``x`` with its first entry alone."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0 or len(x) == 1:
        return np.zeros(len(x))
    v = x / scale
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def dqds(q: list[float], e: list[float]) -> list[float]:
    """The squared singular values, falling, of the bidiagonal with squared diagonal q and squared superdiagonal e."""
    found, work, tiny = [], [(list(q), list(e), 0.0)], np.finfo(float).eps ** 2
    while work:
        q, e, shift = work.pop()
        sweeps = 0
        while q:
            n = len(q)
            # A bidiagonal falls apart where its superdiagonal is nothing beside what was shifted away and stands below it.
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= tiny * (shift + min(q[k], q[k + 1]))), None)
            if n == 1 or cut == n - 2:
                found.append(shift + q.pop())
                if e:
                    e.pop()
                continue
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], shift))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if sweeps == 0 and q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            tau = 0.0
            if sweeps:
                # The lesser eigenvalue of the last two by two, a little reduced; a shift that is too large is taken back.
                a, b, c = q[-2] + e[-2] if n > 2 else q[-2], q[-1] + e[-1], q[-2] * e[-1]
                mean = (a + b) / 2
                top = mean + math.sqrt(((a - b) / 2) ** 2 + c)
                tau = max(0.0, (a * b - c) / top if top else 0.0) * (1 - 1e-10)
            while True:
                done = _sweep(q, e, tau)
                if done is not None:
                    break
                tau = tau / 4 if tau > tiny * (shift + max(q)) else 0.0
            q, e = done
            shift += tau
            sweeps += 1
    return sorted(found, reverse=True)


def _sweep(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float]] | None:
    """One differential step with a shift; none where a value would fall below zero."""
    d, qs, es = q[0] - tau, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        ratio = q[k + 1] / top if top else 0.0
        qs.append(top)
        es.append(e[k] * ratio)
        d = d * ratio - tau if top else q[k + 1] - tau
    return (qs + [d], es) if d >= 0 else None


def twisted(a: np.ndarray, b: np.ndarray, value: float, against: list[np.ndarray]) -> np.ndarray:
    """The unit right singular vector of the bidiagonal (a, b) for the squared singular value ``value``, orthogonal to
    ``against``: T - value = B'B - value is factored from both ends, and the two meet where the pivot is least."""
    n = len(a)
    diag = a ** 2 + np.append(0.0, b ** 2)
    off = a[:-1] * b
    small = np.finfo(float).eps * max(diag.max(initial=0.0), 1e-300)
    down, up = np.empty(n), np.empty(n)
    fixed = lambda x: x if abs(x) > small * 1e-3 else math.copysign(small * 1e-3, x or 1.0)
    down[0] = fixed(diag[0] - value)
    for k in range(1, n):
        down[k] = fixed(diag[k] - value - off[k - 1] ** 2 / down[k - 1])
    up[-1] = fixed(diag[-1] - value)
    for k in range(n - 2, -1, -1):
        up[k] = fixed(diag[k] - value - off[k] ** 2 / up[k + 1])
    pivot = down + up - (diag - value)
    order = np.argsort(np.abs(pivot), kind="stable")
    for at in order:
        z = np.zeros(n)
        z[at] = 1.0
        for k in range(at - 1, -1, -1):
            z[k] = -off[k] / down[k] * z[k + 1]
        for k in range(at + 1, n):
            z[k] = -off[k - 1] / up[k] * z[k - 1]
        z /= np.linalg.norm(z)
        for _ in range(2):
            for other in against:
                z = z - (other @ z) * other
        if (size := np.linalg.norm(z)) > 0.1:
            return z / size
    # Nothing of the twists is left outside the others: any direction of the same value serves.
    z = np.linalg.svd(np.array(against))[2][-1]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest squared singular values of R above rounding, and their right singular vectors as rows."""
    a, b, reflections = bidiagonal(r)
    # Split where the superdiagonal vanishes: vectors of different parts are orthogonal of themselves.
    scale = np.abs(np.concatenate((a, b))).max(initial=0.0)
    cuts = np.flatnonzero(np.abs(b) <= np.finfo(float).eps * scale) + 1
    pairs = []
    for lo, hi in zip([0, *cuts], [*cuts, len(a)], strict=True):
        q, e = (a[lo:hi] ** 2).tolist(), (b[lo:hi - 1] ** 2).tolist()
        pairs += [(v, lo, hi) for v in dqds(q, e)]
    pairs.sort(key=lambda p: -p[0])
    values, vectors, parts = [], [], []
    for value, lo, hi in pairs[:k]:
        if value <= RANK * pairs[0][0] or value == 0:
            break
        near = [v[lo:hi] for v, w, p in zip(vectors, values, parts, strict=True) if p == lo and abs(w - value) <= CLOSE * w]
        z = np.zeros(len(a))
        z[lo:hi] = twisted(a[lo:hi], b[lo:hi - 1], value, near)
        values.append(value)
        vectors.append(z)
        parts.append(lo)
    out = []
    for z in vectors:
        for j in range(len(reflections) - 1, -1, -1):
            v = reflections[j]
            z[j + 1:] -= 2 * (v @ z[j + 1:]) * v
        out.append(z)
    return np.array(values), np.array(out).reshape(len(out), len(a))


def fit_whitening(fit: DataFrame, k: int) -> Whitening | None:
    """Fit on distinct integer vectors ``x``; none where there is none."""
    n, sums = totals(fit)
    if not n:
        return None
    r = reduced(fit, n, sums)
    values, components = directions(r, k)
    return Whitening(n, sums, components, values / n, float((r ** 2).sum()) / n)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened list's covariance minus the identity, added up task by task."""
    k = len(model.values)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, outer = np.zeros(k), np.zeros((k, k))
        for frame in frames:
            if len(frame):
                w = model.project(matrix(frame["x"]))
                total, outer = total + w.sum(axis=0), outer + w.T @ w
        yield pd.DataFrame({"i": np.arange(k + k * k), "v": np.concatenate((total, outer.ravel()))})

    if not k:
        return 0.0
    rows = fit.mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    sums = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]) / model.n
    mean, outer = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(outer - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, k: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``id_col``, component, n, deviation, whitened, explained, identity_error) of every vector that takes part and every component up to ``k``."""
    vectors = integer_vectors(rows, id_col, vec_col, scale)
    kind = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double"
    fit = stored(vectors.groupBy("x").agg(F.lit(1)).select("x"))
    model = fit_whitening(fit, k)
    held = len(model.values) if model else 0
    error = identity_error(fit, model) if held else 0.0

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame) and held:
                x = matrix(frame["x"])
                off = pd.array(model.deviations(x), dtype="Int64")
                yield pd.DataFrame({id_col: frame["id"].repeat(held).reset_index(drop=True), "component": np.tile(np.arange(1, held + 1), len(frame)),
                                    "n": model.n, "deviation": off.repeat(held), "whitened": model.project(x).ravel()})

    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if held else F.array(F.lit(0.0))
    return vectors.mapInPandas(work, kind).withColumns({
        "explained": F.element_at(shares, F.col("component")), "identity_error": F.lit(error)})
