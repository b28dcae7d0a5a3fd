"""Operators on single texts against brute force: BPE, language model, quality, toxicity, packing, sharding."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

from pyspark.sql import functions as F

from spanloom.llm import bpe, packing, quality, scoring, sharding, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(key):
    return zlib.crc32(str(key).encode())


def test_bpe_equals_tiktoken_and_round_trips(spark, docs_of, odd_texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*odd_texts[:9], "don't  stop 1234567 日本語　😀\x00", "aaaaaaaaaaab" * 200]
    vocab = bpe.vocabulary(spark, path, public_tokenizers.PATTERN)
    got = rows(bpe.round_trip(docs_of(texts), vocab))
    lists = rows(bpe.encode(docs_of(texts), vocab))
    back = rows(bpe.decode(bpe.encode(docs_of(texts), vocab), vocab))
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert lists[i]["ids"] == ids and bytes(back[i]["decoded"]) == (t or "").encode()
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(" ".join(map(str, ids)).encode())
        assert got[i]["decoded_sha256"] == sha((t or "").encode())
    assert bpe.round_trip(docs_of([]), vocab).count() == 0


def test_two_vocabularies_of_one_pattern_keep_apart(spark, tmp_path):
    """Workers are reused, so the second vocabulary meets the encoder of the first."""
    lines = [base64.b64encode(bytes([255 - b])) + b" %d" % b for b in range(256)] + [base64.b64encode(b"ab") + b" 256"]
    (tmp_path / "small.tiktoken").write_bytes(b"\n".join(lines))
    docs = spark.createDataFrame([(0, "abab hello")], "doc_id long, text string").coalesce(1)
    first = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    second = bpe.vocabulary(spark, str(tmp_path / "small.tiktoken"), public_tokenizers.PATTERN)
    for _ in range(2):
        large, small = (bpe.encode(docs, v).first()["ids"] for v in (first, second))
        assert small == [256, 256] + [255 - b for b in b" hello"] and large != small and len(large) < len(small)


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    import pyarrow as pa

    got = bpe.PerfectHash(keys).index(pa.array(keys, pa.binary()))
    assert got.tolist() == list(range(3000))


def test_language_model_base_and_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows(scoring.score(docs))
    texts = {r[0]: (r[1] or "").encode().lower().split() + [None] for r in docs.select("doc_id", "text").collect()}
    train = {i for i in texts if crc(i) % 5 != 1}
    counts = Counter(w for i in train for w in texts[i])
    n, v = sum(counts.values()), len(counts)
    score = base = 0.0
    for i, words in texts.items():
        r = got[i]
        assert r["held_out"] == (i not in train) and r["train_tokens"] == n
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(counts[w] > 0 for w in words)
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and r["score"] < 0
        if r["held_out"]:
            score, base = score + r["score"], base + r["base_score"]
    assert score > base  # the mixture is better than unigrams on texts it has not seen


def test_language_model_odd_rows(docs_of, odd_texts):
    got = scoring.score(docs_of(odd_texts + ["x"], [None, 5, 5, *range(6, 16)])).collect()
    assert len(got) == len(odd_texts) + 1 and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in got)
    assert scoring.score(docs_of([])).count() == 0


def test_quality_base_features(docs_of, odd_texts):
    texts = [*odd_texts, "a b c a b c a b c", "x # $ | < >\nx # $ | < >\n\n\nx"]
    got = rows(quality.judge(docs_of(texts), np.zeros(quality.BUCKETS), 0.0))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.split()]
        windows = Counter(zip(words, words[1:], words[2:]))
        twice = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
        want = {"n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_repeat_words": len(twice),
                "n_symbols": sum(raw.count(x) for x in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), "n_dup_lines": len(lines) - len(set(lines))}
        assert {k: got[i][k] for k in want} == want, (i, want)
        assert got[i]["base_failed"] == (len(words) < 50 or 100 * len(twice) > 50 * len(words))


def test_quality_keeps_labelled_good_texts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs, labels)
    judged = quality.judge(docs, *model).join(labels, "doc_id").where("not base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("not kept").count() >= 0.8 * bad.count()
    kept = quality.keep(docs, *model)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs, *model).where("kept").count()


def test_quality_without_labels(spark, docs_of):
    docs = docs_of(["w " * 10, " ".join(f"v{i}" for i in range(60))])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in quality.judge(docs, *quality.fit(docs, empty)).orderBy("doc_id").collect()] == [False, True]


def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id")
    held = scored.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).collect()
    hit = [r for r in held if r["toxic"] == 1 and r["score"] >= 0.3]
    wrong = [r for r in held if r["toxic"] == 0 and r["score"] >= 0.3]
    assert len(hit) >= 0.75 * sum(r["toxic"] == 1 for r in held)
    assert len(wrong) <= 0.03 * sum(r["toxic"] == 0 for r in held)


def test_toxicity_odd_rows(spark, docs_of, odd_texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(odd_texts)
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in got)


def test_packing_boundaries_are_optimal():
    import itertools

    longest, counts = np.array([1, 3, 4, 9, 10, 30]), np.array([5, 1, 7, 2, 2, 1])
    for k in (1, 2, 3, 6, 9):
        got = packing.boundaries(longest, counts, k)
        cost = lambda cuts: sum(n * min(c for c in cuts if c >= x) for x, n in zip(longest, counts))
        best = min(cost((*c, 30)) for j in range(k) for c in itertools.combinations(longest[:-1], min(j, 5)))
        assert len(got) <= k and cost(got) == best


def test_packing_boundaries_of_long_texts_are_optimal():
    """Lengths far above any bin width, against the plain dynamic programming."""
    rng = np.random.default_rng(6)
    for n, top in ((1, 10**7), (40, 5000), (120, 10**7)):
        sizes = np.unique(np.concatenate([rng.integers(0, top, n), np.exp(rng.uniform(0, np.log(top), n)).astype(int)]))
        counts = rng.integers(1, 50, len(sizes))
        ahead = np.concatenate(([0], np.cumsum(counts)))
        best = [0] + [math.inf] * len(sizes)
        cost = lambda cuts: sum(int(c) * int(min(x for x in cuts if x >= s)) for s, c in zip(sizes, counts))
        for k in range(1, 9):
            best = [math.inf] + [min(best[i] + int(ahead[j] - ahead[i]) * int(sizes[j - 1]) for i in range(j)) for j in range(1, len(sizes) + 1)]
            got = packing.boundaries(sizes, counts, k)
            least = best[-1] if k == 1 else min(least, best[-1])
            assert len(got) <= k and got == sorted(got) and got[-1] == sizes[-1] and cost(got) == least


def test_packing_batches(spark, docs_of, odd_texts):
    got = packing.pack(docs_of(odd_texts + ["b c"] * 50, [None, 1, 1, *range(3, 62)]), buckets=4, budget=64).collect()
    assert len(got) == len(odd_texts) + 50
    batches = Counter((r["bucket"], r["batch"]) for r in got)
    for r in got:
        assert r["n_words"] <= r["padded_to"]
        n = batches[r["bucket"], r["batch"]]
        assert n == 1 or n * r["padded_to"] <= 64
    places = {(r["bucket"], r["batch"], r["place"]) for r in got}
    assert len(places) == len(got)
    assert packing.pack(docs_of([])).count() == 0


def test_sharding_is_balanced_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(docs).collect()
    sizes, slots = Counter(), {}
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    assert len(got) == len(texts) and len(sizes) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 16
    assert max(abs(s - mean) for s in sizes.values()) <= 2 * max(r["size"] for r in got)


def test_sharding_splits_a_hot_text_and_takes_odd_rows(docs_of, odd_texts):
    hot = docs_of(["hot text"] * 600 + [f"t{i}" * 3 for i in range(600)])
    sizes = Counter()
    for r in sharding.shard(hot).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.25 * sum(sizes.values()) / 16
    got = sharding.shard(docs_of(odd_texts, [None, None, *range(len(odd_texts) - 2)])).collect()
    assert len(got) == len(odd_texts) and {r["text_crc32"] for r in got if r["size"] == 1} == {0}
    assert sharding.shard(docs_of([])).count() == 0
