"""Prefix trie of conversations against a straight trie of the rebuilt texts."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from spanloom.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
SIZES = {"n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id"}


def straight(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {k: [t[2:] for t in sorted(v)] for k, v in convs.items()}
    rebuilt = {}
    for k, own in convs.items():
        h = zlib.crc32(str(k).encode()) % 4
        rebuilt[k] = tuple(convs.get(k - k % 20, [])[:h] + own[h:])
    members = {}
    for k, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(k)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}
    out = {}
    for p, who in sorted(members.items(), key=lambda x: -len(x[0])):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = sorted(k for k in who if len(rebuilt[k]) == len(p))
        below = [out[q] for q in kids[p]]
        out[p] = (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(below), sum(b[5] for b in below) or int(not below),
                  (len(who) - 1) * words + sum(b[6] for b in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


def got(spark, rows, schema=TURNS):
    return sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=str)


def talk(seed, n):
    """Conversations that share heads, whole copies, one long one, and ids with gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        conv = int(k * (1 + seed % 3))
        size = 60 if k == 7 else int(rng.integers(1, 7))
        for t in range(size):
            pick = int(rng.integers(3)) if k % 3 else 0
            rows.append((conv, t, ["user", "assistant", None][t % 3], f"turn {t} says {pick} " + "word " * pick))
    rng.shuffle(rows)
    return [(int(a), int(b), c, d) for a, b, c, d in rows]


@pytest.mark.parametrize("seed,run", [(0, 4096), (1, 4), (2, 4096)])
def test_trie_equals_a_straight_trie(spark, monkeypatch, seed, run):
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "PIECE", 9 if seed else 1 << 16)
    rows = talk(seed, 70)
    assert got(spark, rows) == straight(rows)


def test_conversations_that_cross_ranges(spark):
    """One conversation holds most rows, so its pieces lie in several ranges."""
    rows = [(0, t, "user", f"t{t % 5}") for t in range(400)] + [(20 + k, t, "user", f"t{t % 5}") for k in range(4) for t in range(30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert prefix_trie._ranges(prefix_trie._turns(spark.createDataFrame(rows, TURNS), 0)).select("range").distinct().count() > 3
        assert got(spark, rows) == straight(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (1, 0, None, None), (1, 0, None, None), (2, 1, "", ""), (None, 1, "a", "b"), (23, 0, "q", " \n "), (40, 0, "a", "w " * 50_000),
            (41, 0, "a", "w " * 50_000)]
    assert got(spark, rows) == straight(rows)
    assert got(spark, []) == []
    wide = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURNS + ", e1 long, depth long, owner long, range long")
    assert sorted(map(tuple, prefix_trie.prefix_trie(wide).collect()), key=str) == straight(rows)


def test_hashes_that_meet_are_drawn_anew(spark, monkeypatch):
    """With hashes of few values the first seeds name different turns alike; the verification must see it."""
    rows, turns, seeds = talk(1, 30), prefix_trie._turns, []

    def weak(conversations, seed):
        seeds.append(seed)
        out = turns(conversations, seed)
        return out if seed == 2 else out.selectExpr("conv_id", "turn", "e1 % 3 as e1", "e2 % 3 as e2", "words", "role", "text")

    monkeypatch.setattr(prefix_trie, "_turns", weak)
    assert got(spark, rows) == straight(rows) and seeds == [0, 1, 2]
