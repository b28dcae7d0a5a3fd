"""Whitening against a dense eigendecomposition, and odd rows."""

import numpy as np
import pytest

from spanloom.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def dense(data, dim):
    """n, sums, deviations, eigenvalues and whitened values by formula."""
    rows = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in data
            if e and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    fit = np.array(sorted({tuple(x) for _, x in rows}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, base = np.linalg.eigh(centred.T @ centred / n)
    return rows, n, sums, values[::-1], base[:, ::-1]


def check(got, data, dim, k=4):
    rows, n, sums, values, base = dense(data, dim)
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for i, x in rows:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        assert all(deviation in [r["deviation"] for r in rows] for rows in by[i].values())  # an id may be repeated
        for r in (r for c in by[i].values() for r in c):
            assert r["n"] == n and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    for c in range(1, k + 1):
        want = {i: (x - sums / n) @ base[:, c - 1] / np.sqrt(values[c - 1]) for i, x in rows}
        sign = np.sign(sum(by[i][c][0]["whitened"] * want[i] for i in want))
        assert all(any(r["whitened"] == pytest.approx(sign * want[i], abs=1e-7) for r in by[i][c]) for i in want)


def test_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    points = (rng.normal(size=(300, 24)) * np.linspace(2, 0.2, 24)) @ turn + 3
    data = [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]
    data += [(300 + k, data[5][1]) for k in range(200)]  # copies count once in the fit
    got = whitening.whiten(frame := spark.createDataFrame([(*d, 0) for d in data], VECTORS), whitening.fit(frame)).collect()
    check(got, data, 24)


def test_iteration_reaches_double_precision():
    """Close, equal and vanishing eigenvalues, and fewer dimensions than components."""
    rng = np.random.default_rng(4)
    for values in ([5, 5, 5, 5, 1, 0.1] + [0.01] * 30, [1 + 1e-4 * k for k in range(40)], [3, 2, 1], [7], [2, 0, 0, 0, 0, 0], [0.0] * 9):
        turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        matrix = (turn * values) @ turn.T
        want = min(4, len(values))
        got, base = whitening.jacobi_davidson(lambda b: matrix @ b, len(values), want)
        top = max(max(values), 1e-300)
        assert np.allclose(got, sorted(values, reverse=True)[:want], atol=1e-12 * top)
        assert np.abs(matrix @ base - base * got).max() <= 1e-13 * top * len(values)
        assert np.abs(base.T @ base - np.eye(want)).max() < 1e-12


def test_odd_rows(spark):
    bad = [(90, None), (91, [1.0, None]), (92, [float("nan"), 1.0]), (93, [float("inf"), 1.0]), (94, []), (95, [1.0, 2.0, 3.0]), (None, [0.5, 0.25])]
    data = [(i, [float(i % 7), float(i * i % 5)]) for i in range(40)] + [(3, [3.0, 4.0])]
    frame = spark.createDataFrame([(*d, None, 1, 2) for d in data + bad], VECTORS + ", x int, dim int")
    got = whitening.whiten(frame, whitening.fit(frame)).collect()
    assert len(got) == 2 * 42 and sum(r["vec_id"] is None for r in got) == 2
    check(got, data + [bad[-1]], 2, 2)
    assert whitening.fit(spark.createDataFrame([], VECTORS)) is None
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0, 5.0], 0) for i in range(5)], VECTORS)
    got = whitening.whiten(same, whitening.fit(same)).collect()
    assert len(got) == 20 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0, 0.0, 0.0], 0) for i in range(9)], VECTORS)
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)


def test_no_usable_row(spark, tmp_path):
    spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op12_embedding_whitening(spark, str(tmp_path)).count() == 0


def test_large_entries_keep_exact_deviations(spark):
    data = [(0, [1e9, 2.0]), (1, [-1e9, 3.0]), (2, [1e30, 1.0]), (3, [5.0, 1.0])]
    frame = spark.createDataFrame([(i, e, 0) for i, e in data], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame, whitening.fit(frame)).where("component = 1").collect()}
    assert got == {0: None, 1: None, 2: None, 3: None}
