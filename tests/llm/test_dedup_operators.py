"""Operators on pairs and groups against brute force, and the pipeline."""

import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, line_dedup, ngram_join, repeats, vectors
from spanloom.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int"


def roots(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != 200}


def brute_vectors(data):
    good = [(i, np.array(e, float), lab) for i, e, lab in data
            if e is not None and lab is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = []
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[k + 1:]:
            if a == b and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((i, j))
    return links


def test_vectors_find_planted_links(spark):
    rng = np.random.default_rng(5)
    data = []
    for g in range(30):
        centre = rng.normal(size=16)
        for _ in range(1 + g % 9):
            data.append((len(data), (centre + rng.normal(size=16) * 0.12).astype(np.float32).tolist(), g % 3))
    data += [(len(data) + k, data[4][1], data[4][2]) for k in range(5)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()}
    links = brute_vectors(data)
    found = sum(r["n_links"] for r in got.values()) / 2
    assert len(links) > 50 and 0.95 * len(links) <= found <= len(links)
    if found == len(links):
        want = roots([d[0] for d in data], links)
        assert {i: r["component_id"] for i, r in got.items()} == want


def test_vectors_odd_rows(spark):
    data = [(0, None, 1), (1, [0.0, 0.0], 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 1), (4, [1.0, 0.0], None), (5, [], 1),
            (6, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (7, [2.0, 0.0], 1), (None, [1.0, 0.01], 1), (8, [1.0, 0.0], 2)]
    got = vectors.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert all(by[i] == [(0, i, True)] for i in (0, 1, 2, 3, 4, 5, 8))
    assert by[6] == [(3, 6, True)] and by[7] == [(3, 6, False)] * 2 and by[None][0][0] == 3
    assert vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_of_different_lengths_never_link(spark):
    data = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.001], 0), (3, [1.0, 0.001, 0.0], 0), (4, [0.0, 1.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()}
    assert got == {0: (1, 0), 2: (1, 0), 1: (1, 1), 3: (1, 1), 4: (0, 4)}


def test_vectors_count_once_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    data = [(i, (centre + rng.normal(size=8) * 0.02).astype(np.float32).tolist(), 0) for i in range(40)]
    got = vectors.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()
    assert sum(r["n_links"] for r in got) == 2 * len(brute_vectors(data)) and {r["component_id"] for r in got} == {0}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def near_texts(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n):
        words = [f"g{g}w{i}" if rng.random() < 0.7 else f"c{rng.integers(40)}" for i in range(int(rng.integers(20, 160)))]
        for _ in range(int(rng.integers(1, 7))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = f"e{rng.integers(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [256, 5])
def test_ngram_join_equals_brute_force(docs_of, odd_texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = odd_texts[:7] + near_texts(25, 1) + ["The  QUICK brown fox jumps over", "the quick brown fox jumps over"]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs_of(texts)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_ngram_join_of_one_large_group(docs_of, monkeypatch):
    """Copies with one or two words changed: many links to few texts, and blocks that hold many classes."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(3)
    words, texts = [f"w{i}" for i in range(50)], []
    for k in range(90):
        copy = list(words)
        for at in rng.integers(50, size=1 + k % 2):
            copy[int(at)] = f"e{rng.integers(10**6)}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(docs_of(texts)).collect()}
    assert got == roots(range(90), links) and 1 < len(set(got.values())) < 90


def test_ngram_join_of_two_large_families_keeps_tasks_small(docs_of, monkeypatch):
    """Two families just too different to link, in the same blocks, with one pair of texts that does link."""
    block, met = 16, []
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join.c, "drop_staged", lambda *frames: None)
    docs = docs_of([])
    sort = type(docs).sortWithinPartitions

    def noted(df, *keys):
        met.append(df.groupBy(*keys).count())
        return sort(df, *keys)

    monkeypatch.setattr(type(docs), "sortWithinPartitions", noted)
    rng = np.random.default_rng(5)
    first = [f"w{i}" for i in range(1000)]
    second = [f"v{i}" if i % 48 == 7 else w for i, w in enumerate(first)]
    between = first[:100] + second[100:]
    for bridge in (False, True):
        texts = []
        for base in (first, second):
            for _ in range(100):
                copy = list(base)
                copy[int(rng.integers(1000))] = f"e{rng.integers(10**6)}"
                texts.append(" ".join(copy))
        texts += [" ".join(second if bridge else first), " ".join(first[:500] + between[500:] if bridge else first + ["tail"])]
        sets = [shingles(t) for t in texts]
        links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(docs_of(texts)).collect()}
        assert got == roots(range(len(texts)), links) and len(set(got.values())) == 2 - bridge
        assert max(m.agg({"count": "max"}).first()[0] or 0 for m in met) <= 4 * block
        met.clear()


def test_ngram_cells_with_many_candidates_compare_whole_sets():
    """Two cells of families too close for the counts alone: one row asks for whole sets, and those give the links of brute force."""
    rng = np.random.default_rng(9)
    first = [f"w{i}" for i in range(1000)]
    second = [f"v{i}" if i % 48 == 7 else w for i, w in enumerate(first)]
    texts = [second, first[:500] + second[500:]]
    for base in (first, second):
        for _ in range(12):
            copy = list(base)
            copy[int(rng.integers(1000))] = f"e{rng.integers(10**6)}"
            texts.append(copy)
    texts = [" ".join(t).encode() for t in texts]
    sets, side = ngram_join._sets(texts), [1, 0] + [0] * 12 + [1] * 12
    rows = {"x": [0] * 26, "y": [1] * 26, "cell": side, "cls": list(range(26)), "component": side, "n": [len(s) for s in sets],
            "counts": [ngram_join._point(s) for s in sets], "shingles": [s.tobytes() for s in sets]}
    batches = pa.table(rows).to_batches()
    assert [b.to_pylist() for b in ngram_join._search_cells(batches)] == [[{"a": None, "b": None, "x": 0, "y": 1}]]
    words = [shingles(t.decode()) for t in texts]
    want = [(i, j) for i in range(26) for j in range(i) if side[i] != side[j] and 100 * len(words[i] & words[j]) >= 85 * len(words[i] | words[j])]
    got = [(r["a"], r["b"]) for b in ngram_join._link_cells(batches) for r in b.to_pylist()]
    assert want and roots(range(26), got) == roots(range(26), want)


def test_ngram_join_dedup_keeps_one_of_each_group(docs_of):
    docs = docs_of(["a b c d e f g h", "a b c d e f g h", None, "", "z"], [3, 1, 5, None, 7])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in ngram_join.dedup(docs).collect()) == [(False, 0), (True, 1), (True, 5), (True, 7)]
    assert ngram_join.near_copies(docs_of([])).count() == 0


def test_a_staged_table_leaves_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in (str(files.getAllFiles().apply(i)) for i in range(files.getAllFiles().size())) if "shuffle_" in f}
    held, set_to = shuffled(), spark.conf.get(common.CLEANUP, None)
    out = common.staged(spark.range(5000).selectExpr("id % 977 as k").groupBy("k").count(), "counts")
    until = time.time() + 20
    while shuffled() - held and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - held and spark.conf.get(common.CLEANUP, None) == set_to
    assert out.count() == 977 and out.agg({"count": "sum"}).first()[0] == 5000


def test_ngram_blocks_leave_out_sets_too_far_apart_in_size(spark):
    rows = [(1, 10, [7, 8]), (2, 100, [7, 9]), (3, 118, [9]), (4, 117, [9, 8]), (5, 1000, [9]), (6, 11, [8])]
    small, large = ngram_join._blocks(spark.createDataFrame(rows, "cls long, n long, head array<long>"))
    got = defaultdict(set)
    for r in small.collect():
        got[r["block"]].add(r["cls"])
    # 100 and 118 are further apart than 85 %, but both link with 117; block 7 has no two sets that can link.
    assert got == {8: {1, 6}, 9: {2, 3, 4}} and large.isEmpty()


def test_ngram_join_puts_a_passage_of_many_texts_last(docs_of):
    """A passage in more texts than a block holds is common, though it is in a small share of the texts."""
    texts = [" ".join(f"t{i}w{k}" for k in range(12)) + (" one passage that many share" if i % 7 == 0 else "") for i in range(2800)]
    common_ones = ngram_join.common_shingles(docs_of(texts))
    assert set(ngram_join._sets([b"one passage that many share"])[0]) <= set(common_ones)
    assert len(common_ones) == 2


def test_ngram_join_by_bitmap_equals_broadcast(docs_of, odd_texts, monkeypatch):
    texts = odd_texts[:7] + near_texts(12, 4)
    texts += texts[5:30]
    docs = docs_of(texts, [None if i % 11 == 3 else i for i in range(len(texts))])
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(ngram_join.near_copies(docs)), rows(ngram_join.dedup(docs))
    monkeypatch.setattr(ngram_join, "LISTED", -1)
    assert (rows(ngram_join.near_copies(docs)), rows(ngram_join.dedup(docs))) == want
    assert 0 < len(want[1]) < len(texts)


def brute_lines(texts, ids):
    key = lambda x: bytes(x, "utf-8").strip(b" \t\n\r\x0b\x0c").lower().decode()
    holders = defaultdict(set)
    for i, t in zip(ids, texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    kept = {}
    for i, t in zip(ids, texts):
        parts = (t or "").split("\n")
        stay = [x for x in parts if not (len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        kept[i] = (len(parts), len(parts) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return kept


def test_line_dedup_equals_brute_force(spark, tmp_path, docs_of):
    line = "This Is A Common line of text"
    texts = [None, "", f"{line}\nown", f" {line.upper()} \nx\n{line}", f"\x0b{line}", "short\n" * 3, f"a\n{line}é\n" * 2, "y\n" * 11 + line,
             *[f"other common line of text\nrow {i}" for i in range(50)]]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == brute_lines(texts, range(len(texts)))


@pytest.mark.parametrize("open_rows", [1 << 16, 3])
def test_line_dedup_across_tasks(docs_of, monkeypatch, open_rows):
    monkeypatch.setattr(line_dedup, "OPEN_ROWS", open_rows)
    texts = ["a hot line that everyone has got\nrest %d" % i for i in range(300)] + [f"line number {i % 40} of the common kind" for i in range(200)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(texts).repartition(7)).collect()}
    want = brute_lines(texts, range(len(texts)))
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in out.items()} == {i: w[2] for i, w in want.items()}


def brute_repeats(texts):
    seen = defaultdict(set)
    raw = [(t or "").encode() for t in texts]
    for i, b in enumerate(raw):
        for p in range(len(b) - 399):
            seen[b[p:p + 400]].add((i, p))
    out = []
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if len(seen[b[p:p + 400]]) > 1:
                gone[p:p + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts(seed):
    rng = np.random.default_rng(seed)
    own = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    shared = [own(n) for n in (399, 400, 401, 450, 560, 700, 1500)]
    texts = [None, "", "short", "=" * 900, "ab" * 700, "é" * 500 + own(50)]
    for _ in range(24):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            parts.append(own(int(rng.integers(0, 300))))
            s = shared[int(rng.integers(len(shared)))]
            cut = int(rng.integers(0, 40))
            parts.append(s[cut:] if rng.random() < 0.4 else s)
        texts.append("".join(parts))
    return texts + [texts[-1], own(1000), shared[5] + "x" + shared[5]]


@pytest.mark.parametrize("seed,run_bytes,part_bytes", [(1, 16 << 20, 24 << 20), (2, 20_000, 8_000)])
def test_suffix_dedup_equals_brute_force(spark, tmp_path, docs_of, monkeypatch, seed, run_bytes, part_bytes):
    monkeypatch.setattr(repeats, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(repeats, "PART_BYTES", part_bytes)
    texts = repeat_texts(seed)
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


@pytest.mark.parametrize("small", [repeats.SMALL, -1])
def test_suffix_dedup_hashes_few_single_strings(spark, tmp_path, docs_of, monkeypatch, small):
    """Strings at the edge of a passage that many texts share are compared in blocks, also where texts are joined by shuffle."""
    rng = np.random.default_rng(11)
    own = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    passages = [own(700) for _ in range(6)]
    texts = [own(int(rng.integers(100, 300))) + passages[k % 6] + own(150) for k in range(72)] + [own(900) for _ in range(20)]
    texts += [passages[0][:430], passages[0][7:431] + own(3), "=" * 900, None, "", texts[0]]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    counts, staged = {}, repeats.c.staged

    def counting(df, name):
        out = staged(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "SMALL", small)
    monkeypatch.setattr(repeats.c, "staged", counting)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    assert 0 < counts["strings"] < 30 * len(texts)


def test_texts_without_a_listed_key_stay_out_of_the_shuffle(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("xxhash64(id) as key", "id")
    table = spark.range(0, 20_000, 40).selectExpr("xxhash64(id) as key", "id + 1 as more")
    some = {r["id"] for r in repeats._marked(rows, table, 500).collect()}
    assert set(range(0, 20_000, 40)) <= some and len(some) < 500 + 2_000
    assert {r["id"] for r in repeats._marked(rows, table, 500, "left_anti").collect()} == set(range(20_000)) - some
    monkeypatch.setattr(repeats, "SMALL", -1)
    want = {(k, k + 1 if k % 40 == 0 else None) for k in range(20_000)}
    assert {(r["id"], r["more"]) for r in repeats._joined(rows, table, F.lit(8), "left").collect()} == want
    assert {(r["id"], r["more"]) for r in repeats._joined(rows, table, F.lit(8)).collect()} == {x for x in want if x[1]}


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(4)
    runs, every = [], []
    for _ in range(5):
        strings = sorted({bytes(rng.integers(97, 99, int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(30)})
        lcp = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(strings, strings[1:])]
        runs.append(repeats.Run(list(range(len(strings))), [len(s) for s in strings], lcp, b"".join(s[k:] for s, k in zip(strings, lcp))))
        every.append(strings)
    merged = [(every[a][i], n) for a, i, n in repeats.merge(runs)]
    strings = [s for s, _ in merged]
    assert strings == sorted(s for r in every for s in r)
    for (a, _), (b, n) in zip(merged, merged[1:]):
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_empty_tables(docs_of):
    assert repeats.dedup(docs_of([])).count() == 0 and line_dedup.dedup(docs_of([])).count() == 0


def test_pipeline_equals_its_parts_by_brute_force(spark, tmp_path, docs_of):
    import corpus_pipeline

    texts = [t for t in near_texts(40, 7)]
    shared = " ".join(f"passage{i} of shared words" for i in range(40))
    texts += [f"{' '.join(f'u{k}v{i}' for i in range(80))}\n{shared}" for k in range(4)] + ["bad " * 100, "few words", None, ""]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["n_words"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # Quality: without labels only the simple rules decide.
    kept = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        windows = defaultdict(int)
        for k in range(len(w) - 2):
            windows[tuple(w[k:k + 3])] += 1
        twice = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(twice) <= 50 * len(w):
            kept[i] = t
    # Lines.
    holders = defaultdict(set)
    for i, t in kept.items():
        for x in t.split("\n"):
            holders[x.strip().lower()].add(i)
    lines = {i: "\n".join(x for x in t.split("\n") if not (len(x.strip()) >= 20 and len(holders[x.strip().lower()]) >= 3
             and i != max(holders[x.strip().lower()]))) for i, t in kept.items()}
    # Near copies.
    sets = {i: shingles(t) for i, t in lines.items()}
    links = [(i, j) for i in sets for j in sets if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = roots(sets, links)
    single = {i: t for i, t in lines.items() if root[i] == i}
    # Repeats.
    ids = sorted(single)
    raw = [single[i].split() for i in ids]
    seen = defaultdict(int)
    for w in raw:
        for p in range(len(w) - 49):
            seen[tuple(w[p:p + 50])] += 1
    want = {}
    for i, w in zip(ids, raw):
        gone = {q for p in range(len(w) - 49) if seen[tuple(w[p:p + 50])] > 1 for q in range(p, p + 50)}
        want[i] = len(w) - len(gone)
    assert got == want


def brute_words(texts):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = defaultdict(set)
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            seen[tuple(w[p:p + 50])].add((i, p))
    return [[x for q, x in enumerate(w) if not any(len(seen[tuple(w[p:p + 50])]) > 1 for p in range(max(0, q - 49), min(q, len(w) - 50) + 1))] for w in words]


def test_suffix_dedup_by_words(docs_of, odd_texts):
    rng = np.random.default_rng(8)
    own = lambda n: [f"o{rng.integers(10**9)}" for _ in range(n)]
    shared = {n: [f"s{n}w{i}" if i % 3 else "a" for i in range(n)] for n in (49, 50, 51, 120)}
    texts = [None, "", *odd_texts[5:9]]
    for k in range(20):
        parts = [own(int(rng.integers(0, 60))), shared[(49, 50, 51, 120)[k % 4]], own(int(rng.integers(0, 60)))]
        texts.append((" ", "  ", "\n", " \t")[k % 4].join(x for p in parts for x in p))
    got = {r["doc_id"]: r["text"] for r in repeats.dedup(docs_of(texts), words=True).collect()}
    want = brute_words(texts)
    assert [re.findall(rb"[^\x20\x09-\x0D]+", (got[i] or "").encode()) for i in range(len(texts))] == want
    assert got[0] is None and got[1] == "" and sum(len(w) for w in want) < sum(len((t or "").split()) for t in texts)


def test_names_that_clash_and_rows_without_id_survive(spark):
    """Every dedup of the pipeline keeps columns of any name, and rows whose id is null."""
    names = ["_key", "_starts", "_line_id", "_line_bitmap", "_stay_id", "_stay_at", "_row", "_at", "at", "key", "cls", "a.b", "_"]
    line = "the same long line in every document"
    texts = [" ".join(f"w{k}x{i}" for i in range(70)) + f"\n{line}" for k in range(4)] + [None, ""]
    rows = [(None if k == 3 else k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for dedup in (line_dedup.dedup, ngram_join.dedup, repeats.dedup, lambda d: repeats.dedup(d, words=True)):
        out = dedup(docs)
        assert out.columns == docs.columns
        assert sorted(tuple(r)[2:] for r in out.collect()) == sorted(r[2:] for r in rows)
