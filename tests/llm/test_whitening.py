"""The whitening solver against plain linear algebra, the operator against whole-number brute force."""
import math

import numpy as np
import pytest

from feedloom.llm import whitening
from feedloom.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>"


def triangle(x):
    return np.linalg.qr(np.vstack((x, np.zeros((x.shape[1],) * 2))), mode="r")


def matrices():
    rng = np.random.default_rng(7)
    plain = rng.normal(size=(300, 40))
    ring, _ = np.linalg.qr(rng.normal(size=(200, 12)))
    yield "plain", plain
    yield "graded", plain * np.logspace(0, -8, 40)
    yield "low rank", rng.normal(size=(300, 3)) @ rng.normal(size=(3, 40))
    yield "fewer rows than dimensions", plain[:6]
    yield "close values", plain * np.array([1, 1, 1, 1 + 1e-10] + [0.1] * 36)
    yield "equal values", ring
    yield "two groups of equal values", ring * np.array([1.0] * 6 + [0.5] * 6)
    yield "diagonal", np.diag([3.0, 2, 2, 1, 0])
    yield "one dimension", plain[:, :1]
    yield "zero", np.zeros((4, 5))


@pytest.mark.parametrize("name,x", list(matrices()), ids=lambda v: v if isinstance(v, str) else "")
def test_directions(name, x):
    r, truth = triangle(x), np.linalg.svd(x, compute_uv=False) ** 2
    values, vectors = whitening.directions(r, 5)
    top = truth.max(initial=0.0)
    assert len(values) == min(5, (truth > 1e-24 * top).sum() if top else 0)
    assert np.allclose(values, truth[:len(values)], rtol=0, atol=1e-13 * top)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(x.T @ (x @ vectors.T), vectors.T * values, rtol=0, atol=1e-13 * max(top, 1e-300))


def test_dqds_keeps_small_values():
    """A graded bidiagonal whose least singular value an eigensolver of the product would lose."""
    a, b = np.logspace(0, -12, 13), np.logspace(-0.5, -11.5, 12) * 0.3
    found = whitening.dqds((a ** 2).tolist(), (b ** 2).tolist())
    # The product of all values is that of the diagonal, and their sum that of all squares.
    assert math.isclose(sum(map(math.log, found)), 2 * np.log(a).sum(), rel_tol=1e-12)
    assert math.isclose(sum(found), (a ** 2).sum() + (b ** 2).sum(), rel_tol=1e-13)
    assert min(found) < 1e-23


def brute_force(rows, k=4, scale=256):
    """(vec_id, component) -> (n, deviation, whitened, explained), in whole numbers as far as they go."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], dtype=float) / n
    values, vectors = np.linalg.eigh(x.T @ x / n)
    out = []
    for i, v in kept:
        off = [n * c - s for c, s in zip(v, sums)]
        for c in range(min(k, len(sums))):
            e, u = values[-1 - c], vectors[:, -1 - c]
            if e > 1e-12 * values[-1] > 0:
                out.append((i, c + 1, n, sum(o * o for o in off), abs(float(np.array(off) @ u / n / math.sqrt(e))), e / values.sum()))
    return sorted(out, key=str)


def same(got, want):
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in sorted(got, key=str)], [w[4:] for w in want], rtol=1e-9, atol=1e-9)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op12_whiten"](spark, sf).collect()
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    key = lambda r: (r["vec_id"], r["component"])
    want = {w[:2]: w for w in brute_force(rows)}
    assert sorted(map(key, got)) == sorted(want)
    for r in got:
        _, _, n, deviation, size, share = want[key(r)]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert math.isclose(abs(r["whitened"]), size, rel_tol=1e-8, abs_tol=1e-9) and math.isclose(r["explained"], share, rel_tol=1e-10)
    # One sign for all rows: whitened columns are uncorrelated, as no mix of signs would leave them.
    w = np.array([[r["whitened"] for r in sorted(got, key=key) if r["component"] == c] for c in range(1, 5)])
    assert np.allclose(w @ w.T / w.shape[1], np.eye(4), atol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (105, [-0.0, 0.0, -0.001])]
    rows = good + odd + good[:5] + [(None, good[7][1]), (106, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS + ", x string, component string")).collect()
    want = brute_force([r for r in rows if r[0] != 106])
    assert sorted((str(r["vec_id"]), r["component"], r["n"], r["deviation"]) for r in got) == sorted((str(w[0]), *w[1:4]) for w in want)
    assert max(r["component"] for r in got) == 3 and all(r["identity_error"] < 1e-10 for r in got)


def test_nothing_to_whiten(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], VECTORS)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(1, [1e9, 3.0]), (2, [-1e9, 5.0]), (3, [7e8, 1e8]), (4, [1.5, -1e9])]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    want = {w[0]: w[3] for w in brute_force(rows)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_tree_of_triangles(spark, monkeypatch):
    """More tasks than one stack takes, in several levels."""
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    x = np.random.default_rng(5).integers(-500, 500, size=(90, 6))
    fit = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(9)
    n, sums = whitening.totals(fit)
    assert (n, sums) == (90, x.sum(axis=0).tolist())
    r, c = whitening.reduced(fit, n, sums), x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c)
