"""Whitening against a dense eigenvalue solver, and the counts by inertia against it."""

from __future__ import annotations

import math

import numpy as np
import pytest

from topicspark.llm import whitening as W

ROWS = "vec_id bigint, embedding array<float>, label int, n string, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "mine", "mine") for i, v in vectors], ROWS)


def brute(vectors, k=4):
    """{(vec_id, component): (n, deviation, whitened, explained)}; the sign of a component by its largest entry."""
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in kept]
    fit = sorted({tuple(v) for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array(fit, float) - np.array(s) / n
    cov = off.T @ off / n
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for c in range(min(k, len(s))):
        e, u = values[-1 - c], vectors[:, -1 - c]
        if e <= 1e-9 * np.trace(cov):
            continue
        u = u * np.sign(u[np.abs(u).argmax()])
        for i, v in x:
            deviation = sum((n * a - b) ** 2 for a, b in zip(v, s))
            out[(i, c + 1)] = (n, deviation, float((np.array(v) - np.array(s) / n) @ u / np.sqrt(e)), float(e / np.trace(cov)))
    return out


def told(df):
    rows = df.collect()
    errors = {r["identity_error"] for r in rows}
    assert len(errors) <= 1 and all(e < 1e-9 for e in errors)
    return {(r["vec_id"], r["component"]): (r["n"], r["deviation"], r["whitened"], r["explained"]) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for key, (n, deviation, whitened, explained) in want.items():
        assert got[key][:2] == (n, deviation)
        assert got[key][2] == pytest.approx(whitened, abs=1e-8) and got[key][3] == pytest.approx(explained, rel=1e-10)


def test_whitening_is_the_dense_solver(spark):
    rng = np.random.default_rng(1)
    mixing = rng.standard_normal((9, 9)) * np.array([3, 2, 1.5, 1, 0.5, 0.2, 0.1, 0.05, 0.02])
    rows = [(i, list(rng.standard_normal(9) @ mixing.T / 4)) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a hot vector counts once
    rows += [(2000, None), (2001, []), (2002, [1.0] * 8 + [None]), (2003, [float("nan")] + [0.0] * 8), (2004, [float("inf")] * 9)]
    same(told(W.whiten(table(spark, rows).repartition(5))), brute(rows))


def test_the_embeddings(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = [(r["vec_id"], list(r["embedding"])) for r in rows.collect()]
    same(told(W.whiten(rows)), brute(vectors))


def test_tables_with_little_in_them(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, None), (2, [None])])).count() == 0
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    line = [(i, [0.1 * i, 0.2 * i, 0.0]) for i in range(20)]  # nearly one component
    got = told(W.whiten(table(spark, line + [(99, [1.0])])))
    same({k: v for k, v in got.items() if k[1] == 1}, {k: v for k, v in brute(line).items() if k[1] == 1})
    assert (99, 1) not in got
    one = told(W.whiten(table(spark, [(None, [1.0]), (2, [2.0]), (2, [2.0])])))
    assert set(one) == {(None, 1), (2, 1)}


def test_deviations_beyond_64_bits_are_null(spark):
    rows = [(1, [1e8, 0.0]), (2, [0.0, 3.0]), (3, [1e30, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in W.whiten(table(spark, rows)).collect()}
    assert got[3] is None and set(got) == {1, 2, 3}


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, 0.5], [5, 5, 5, 1, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0, 0], [1e9, 1, 1e-3, 1e-6, 0, 0], [2, 0, 0, 0, 0, 0], [7, 7, 7, 7, 7, 7],
])
def test_slicing_finds_the_leading_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((6, 6)))
    v = q @ np.diag(np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    found = W.leading(v, 4)
    want = [e for e in sorted(values, reverse=True)[:4] if e > 1e-13 * max(values)]
    assert len(found) >= len([e for e in want if e > 1e-12 * max(values)])
    for (e, u), w in zip(found, want):
        assert e == pytest.approx(w, abs=1e-13 * max(values)) and np.linalg.norm(v @ u - e * u) < 1e-13 * max(values) * 10
    basis = np.array([u for _, u in found])
    if min(np.diff(sorted(set(values)))) > 1e-6 if len(set(values)) > 1 else True:
        assert np.allclose(basis @ basis.T, np.eye(len(basis)), atol=1e-9)


def test_counts_by_inertia():
    rng = np.random.default_rng(6)
    for d in (1, 2, 3, 10, 40):
        a = rng.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for s in [*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1, 0.0]:
            assert W.above(a, s) == int((values > s).sum())
    assert W.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
