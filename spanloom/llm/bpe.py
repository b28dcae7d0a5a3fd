"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens by a pattern. The distinct pre-tokens of a chunk are looked up together in a minimal
perfect hash of the vocabulary: a hit is resolved whole. A miss is merged from single bytes with a
heap of candidate merges over linked byte spans, lowest rank first, leftmost first among equals.
Decoding concatenates the vocabulary bytes of the ids.

The vocabulary (a file of base64 bytes and rank per line, named by the caller) is the only thing sent to
all tasks; its size does not depend on the data. Null and empty texts give no ids and decode to nothing.
Repeated rows and ids are encoded row by row; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from . import common as c

MEMO = 600_000  # merged pre-tokens a worker remembers
_PER_BUCKET = 4
_STEP = np.uint64(0xA24BAED4963EE407)


def _hash(keys: pa.Array) -> np.ndarray:
    """Hashes of a binary array without nulls or offset."""
    ends = np.frombuffer(keys.buffers()[1], np.int32)[:len(keys) + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    return c.span_hash(data, ends[:-1], ends[1:])


class PerfectHash:
    """Minimal perfect hash of byte strings: each bucket of keys has a displacement that makes its slots free."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.size = len(keys)
        self.buckets = max(1, n // _PER_BUCKET)
        hashes = _hash(pa.array(keys, pa.binary()))
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        bounds = np.searchsorted((hashes % np.uint64(self.buckets))[order], np.arange(self.buckets + 1))
        members = [order[a:b] for a, b in zip(bounds, bounds[1:])]
        taken = np.zeros(n, bool)
        slot_of = np.zeros(n, np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        by_size = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for b in (b for b in by_size if len(members[b]) > 1):
            step = 0
            while True:  # many displacements at a time
                tries = np.arange(step, step + 64)
                slots = np.sort(self._slots(hashes[members[b]][None, :], tries[:, None]), axis=1)
                good = np.flatnonzero(~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1))
                if len(good):
                    step += int(good[0])
                    break
                step += 64
            slots = self._slots(hashes[members[b]], step)
            self.shift[b], slot_of[members[b]] = step, slots
            taken[slots] = True
        free = iter(np.flatnonzero(~taken))
        for b in (b for b in by_size if len(members[b]) == 1):
            slot = int(next(free))  # a bucket of one key names its slot
            self.shift[b], slot_of[members[b]] = -slot - 1, slot
        self.key_at = np.zeros(n, np.int64)
        self.key_at[slot_of] = np.arange(n)

    def _slots(self, hashes: np.ndarray, step) -> np.ndarray:
        return (c.mix(hashes + np.asarray(step).astype(np.uint64) * _STEP) % np.uint64(self.size)).astype(np.int64)

    def index(self, keys: pa.Array) -> np.ndarray:
        """The only key number that each string can have."""
        hashes = _hash(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[np.where(shift < 0, -shift - 1, self._slots(hashes, np.maximum(shift, 0)))]


class Vocabulary:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            held = f.read()
        self.digest = hashlib.sha256(held).hexdigest()
        pairs = [line.split() for line in held.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pairs = {(k[0], k[1]): r for k, r in self.ranks.items() if len(k) == 2}
        self.pattern = pattern
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.rank_of = np.fromiter(self.ranks.values(), np.int64, len(keys))
        self.keys = pa.array(keys, pa.binary())
        size = int(self.rank_of.max()) + 1
        by_rank: list[bytes] = [b""] * size
        for k, r in self.ranks.items():
            by_rank[r] = k
        self.by_rank = pa.array(by_rank, pa.binary())

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of bytes that are no vocabulary entry as a whole."""
        n = len(piece)
        get, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        width = n + 1
        square = width * width
        end = list(range(1, n + 2))  # end of the span that begins here; 0: no span begins here
        before = list(range(-1, n))  # start of the span that ends here
        first = self.pairs
        # A merge of the spans from a to e is one number: rank, then a, then e.
        heap = [first[x] * square + i * width + i + 2 for i, x in enumerate(zip(piece, piece[1:])) if x in first]
        heapq.heapify(heap)
        while heap:
            a, e = divmod(pop(heap) % square, width)
            m = end[a]
            if not m or m >= n or end[m] != e:
                continue
            end[a], end[m] = e, 0
            before[e] = a
            if a and (r := get(piece[before[a]:e])) is not None:
                push(heap, r * square + before[a] * width + e)
            if e < n and (r := get(piece[a:end[e]])) is not None:
                push(heap, r * square + a * width + end[e])
        out, at, ranks = [], 0, self.ranks
        while at < n:
            out.append(ranks[piece[at:end[at]]])
            at = end[at]
        return tuple(out)


class Encoder:
    """Encodes chunks of texts; lives in a worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (with the total at the end)."""
        parts: list[str] = []
        cuts = [0]
        for text in texts:
            parts += self.find(text)
            cuts.append(len(parts))
        coded = pa.array(parts, pa.string()).dictionary_encode()
        del parts
        codes = coded.indices.to_numpy()
        distinct = coded.dictionary.cast(pa.binary())
        key = self.v.hash.index(distinct)
        hit = pc.equal(self.v.keys.take(pa.array(key)), distinct).to_numpy(zero_copy_only=False)
        sizes = np.ones(len(distinct), np.int64)
        missing = np.flatnonzero(~hit)
        merged = []
        known = self.memo.get
        for i, piece in zip(missing.tolist(), distinct.take(pa.array(missing)).to_pylist()):
            got = known(piece)
            if got is None:
                got = self.v.merge(piece)
                if len(piece) <= 64:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[piece] = got
            merged.append(got)
        sizes[missing] = np.fromiter(map(len, merged), np.int64, len(merged))
        begin = np.zeros(len(distinct) + 1, np.int64)
        np.cumsum(sizes, out=begin[1:])
        flat = np.zeros(begin[-1], np.int64)
        of_miss = np.repeat(~hit, sizes)
        flat[~of_miss] = self.v.rank_of[key[hit]]
        flat[of_miss] = np.fromiter(chain.from_iterable(merged), np.int64, int(of_miss.sum()))
        n = sizes[codes]
        upto = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        ids = flat[np.repeat(begin[:-1][codes] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[np.asarray(cuts)]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        pieces = self.v.by_rank.take(pa.array(ids))
        if not len(ids):
            return [b""] * (len(starts) - 1)
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[:len(pieces) + 1]
        data = memoryview(pieces.buffers()[2])
        return [bytes(data[ends[a]:ends[b]]) for a, b in zip(starts, starts[1:])]


_ENCODERS: dict[tuple[str, str], Encoder] = {}  # by pattern and digest of the vocabulary


def _encoder(shared) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = (shared.value.pattern, shared.value.digest)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def vocabulary(spark, path: str, pattern: str):
    """Broadcast of a vocabulary; its size is that of the file, whatever the data."""
    return spark.sparkContext.broadcast(Vocabulary(path, pattern))


def encode(docs: DataFrame, vocab) -> DataFrame:
    """(doc_id, ids) of every text."""

    def run(batches):
        enc = _encoder(vocab)
        for batch in c.chunks(batches):
            ids, at = enc.encode(pc.fill_null(batch.column(1), "").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    c.tuned(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab) -> DataFrame:
    """(doc_id, decoded) for rows of (doc_id, ids); null ids decode to nothing."""

    def run(batches):
        enc = _encoder(vocab)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            out = enc.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocab) -> DataFrame:
    """Digests of the ids and of what they decode to, in one pass over the texts."""

    def run(batches):
        enc = _encoder(vocab)
        words = pa.array([str(i) for i in range(len(enc.v.by_rank))])
        for batch in c.chunks(batches):
            ids, at = enc.encode(pc.fill_null(batch.column(1), "").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words.take(pa.array(ids)))
            said = pc.binary_join(lists, " ").to_pylist()
            digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), digest(x.encode() for x in said), digest(enc.decode(ids, at))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    c.tuned(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip(c.table(spark, sf_dir, "documents"), vocab)
