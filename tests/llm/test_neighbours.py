"""Nearest neighbours against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from spanloom.llm import neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(data):
    """Nearest rows of every query row, as lists of (score, vec_id)."""
    good = [(i, np.array(e, np.float32).astype(float)) for i, e in data
            if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = defaultdict(list)
    for k, (i, q) in enumerate(good):
        if i % 20 == 0:
            out[i].append(sorted(((-float(q @ x), j) for m, (j, x) in enumerate(good) if m != k and len(x) == len(q)))[:20])
    return out


def found(spark, data, **how):
    rows = neighbours.search(spark.createDataFrame([(*d, 0) for d in data], VECTORS), **how).collect()
    out = defaultdict(dict)
    for r in rows:
        out[r["query_id"]].setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = [len({v for h in got[q].values() for v, _ in h} & {j for _, j in lists[0]}) / len(lists[0]) for q, lists in want.items()]
    return sum(hits) / len(hits)


def same(got, want):
    assert set(got) == {q for q, lists in want.items() if lists[0]}
    for q, lists in want.items():
        for rank in range(1, len(lists[0]) + 1):
            hits = sorted(got[q][rank])
            exact = sorted((x[rank - 1][1], -x[rank - 1][0]) for x in lists)
            assert [v for v, _ in hits] == [v for v, _ in exact] and [s for _, s in hits] == pytest.approx([s for _, s in exact], abs=1e-12)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    same(found(spark, data), brute(data))


@pytest.mark.parametrize("share,least", [(0.8, 0.9), (0.1, 0.35)])
def test_recall_of_vectors_without_structure(spark, monkeypatch, share, least):
    monkeypatch.setattr(neighbours, "LEAST", 64)
    monkeypatch.setattr(neighbours, "SEGMENTS", 31)
    monkeypatch.setattr(neighbours, "ASKED", 30)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = found(spark, data, share=share), brute(data)
    assert all(len(h) == 20 for h in got.values()) and recall(got, want) >= least
    scores = {(q, j): -s for q, lists in want.items() for s, j in lists[0]}
    assert all(s == pytest.approx(scores[q, v]) for q, hits in got.items() for h in hits.values() for v, s in h if (q, v) in scores)


def test_clusters_need_a_small_share(spark, monkeypatch):
    """Long common prefixes: queries stop deep in the trees."""
    monkeypatch.setattr(neighbours, "LEAST", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(3000, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    assert recall(found(spark, data, share=0.3), brute(data)) >= 0.9


def test_norms_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16)) * np.exp(rng.normal(size=(2000, 1))) + 0.5
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    assert recall(found(spark, data), brute(data)) >= 0.95


def test_odd_rows(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (20, None), (40, [0.0, -0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, []), (None, [1.0, 1.0]),
            (1, [1.0, 0.0]), (2, [2.0, 0.0]), (120, [1.0, 2.0, 3.0]), (3, [3.0, 3.0, 3.0]), (-20, [-0.0, 1.0]), (4, [0.0, 1.0]), (140, [1.0, 2.0, 3.0, 4.0])]
    same(found(spark, data), brute(data))
    assert found(spark, []) == {}
    clash = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in data], "vec_id long, embedding array<float>, cls int, h1 int, near int, block int")
    assert neighbours.search(clash).count() == neighbours.search(clash.drop("cls", "h1", "near", "block")).count() > 0


def test_many_copies_of_one_vector(spark):
    """A third of the rows is one vector: its class is searched once, ties go to smaller ids."""
    rng = np.random.default_rng(5)
    data = [(i, [3.0] * 8 if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    same(found(spark, data), brute(data))
