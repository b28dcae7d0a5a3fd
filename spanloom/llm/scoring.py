"""Language-model scoring by deleted interpolation.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end for each text. The probability of a token
after its history is a mixture of the maximum-likelihood estimates of all orders up to ``ORDER`` and a uniform share
for unknown tokens; the weights depend on the bucket (log2) of the history's count. Part of the training
texts is deleted from the counts (``TUNE``), and expectation-maximisation on their tokens, with counts of the rest,
learns the weights. Scores then use the counts of all training texts.

Texts are written in blocks. Each block sends its distinct n-gram hashes, cut by hash range into parts; a part sums
the counts of all blocks and answers each block with the totals of its own n-grams, in order. An n-gram is one entry in each block that
holds it, so a frequent one is no hot key. Blocks and parts have bounded sizes and their number grows with the input;
nothing of the counts goes through the driver. The driver gets the tuning tokens as a histogram of quantised estimates, whose cells
are bounded whatever the input.

Rows are scored one by one: null or empty text is the end token alone; repeated rows get equal scores but count
twice in training; a null id counts as the empty text for the split. Other columns are not read. Without training rows
every probability is that of the unknown token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common as c

ORDER = 2
BLOCK_BYTES = 4 << 20
PART_BYTES = 8 << 20  # text bytes whose n-grams one part counts
TUNE = 12  # one of so many training texts is deleted from the counts for tuning
BUCKETS = 24
STEP = 0.25  # width of the cells of log2 estimates
ROUNDS = 60
_HELD_OUT, _MAIN, _TUNE = 0, 1, 2
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_BLOCK = "block long, tune boolean, doc_ids array<long>, roles array<int>, ends array<long>, payload binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of about BLOCK_BYTES of text; tuning texts have blocks of their own."""
    crc = c.crc_of_id()
    role = F.when(crc % 5 == 1, _HELD_OUT).when(F.floor(crc / 5) % TUNE == 0, _TUNE).otherwise(_MAIN).cast("int")

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        open_: dict[bool, list] = {False: [[], [], [], 0], True: [[], [], [], 0]}

        def out(tune):
            nonlocal made
            ids, roles, texts, _ = open_[tune]
            open_[tune] = [[], [], [], 0]
            number = (task << 24) | made
            made += 1
            raw = b"".join(texts)
            payload = len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([tune]), pa.array([ids], pa.list_(pa.int64())), pa.array([roles], pa.list_(pa.int32())),
                 pa.array([ends], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["block", "tune", "doc_ids", "roles", "ends", "payload"])

        for batch in c.chunks(batches):
            for key, text, kind in zip(batch.column(0).to_pylist(), c.as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                b = open_[kind == _TUNE]
                b[0].append(key), b[1].append(kind), b[2].append(text)
                b[3] += len(text) + 64
                if b[3] >= BLOCK_BYTES:
                    yield out(kind == _TUNE)
        for tune in (False, True):
            if open_[tune][0]:
                yield out(tune)

    return c.staged(docs.select(F.col("doc_id").cast("long"), "text", role.alias("role")).mapInArrow(run, _BLOCK), "lm-blocks")


class Block:
    """Token n-grams of one block: a key for each position and order, the order in its lowest bits."""

    def __init__(self, ends, payload: bytes, order: int) -> None:
        raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), "zstd", asbytes=True)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        t = c.tokens([raw[a:b] for a, b in zip(starts, ends)], lower=True)
        n = len(ends)
        self.n_tokens = t.counts + 1
        last = np.cumsum(self.n_tokens) - 1  # position of each end token
        self.doc = np.repeat(np.arange(n), self.n_tokens)
        word = np.full(len(self.doc), _END, np.uint64)
        inner = np.ones(len(word), bool)
        inner[last] = False
        word[inner] = t.hashes
        place = np.arange(len(word)) - (last - self.n_tokens + 1)[self.doc]
        self.begins = place == 0
        self.keys = []
        history = []  # words before a position, nearest first
        for k in range(order):
            key = c.combine(*history[::-1], word)
            self.keys.append((key & ~np.uint64(7)) | np.uint64(k))
            shifted = np.full(len(word), _BEGIN, np.uint64)
            shifted[k + 1:] = word[:max(0, len(word) - k - 1)]
            shifted[place < k + 1] = _BEGIN
            history.append(shifted)
        self.distinct, self.back = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.order, self.size = order, len(word)

    def part(self, parts: int) -> np.ndarray:
        """Where the keys of each part begin; parts are ranges of keys."""
        return np.searchsorted(((self.distinct >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))


def _count(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """Answers: for each block and part the totals of the block's n-grams; block -1 has the unigram totals."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(np.array(row["ends"]), row["payload"], order)
                role = np.array(row["roles"])[b.doc]
                every = np.tile(role, order)
                main = np.bincount(b.back[every == _MAIN], minlength=len(b.distinct)).astype(np.uint32)
                tune = np.bincount(b.back[every == _TUNE], minlength=len(b.distinct)).astype(np.uint32)
                at = b.part(parts)
                some = [p for p in range(parts) if at[p + 1] > at[p]]
                cut = lambda x: pa.array([c.pack(x[at[p]:at[p + 1]]) for p in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()),
                                                  cut(b.distinct), cut(main), cut(tune)], names=["part", "block", "keys", "main", "tune"])

    def total(t: pa.Table) -> pa.Table:
        keys = [c.unpack(x.as_py(), np.uint64) for x in t.column("keys")]
        sizes = np.cumsum([0, *map(len, keys)])
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = []
        for k in ("main", "tune"):
            mine = np.concatenate([c.unpack(x.as_py(), np.uint32) for x in t.column(k)])
            sums.append(np.bincount(back, mine, len(distinct)).astype(np.uint64))
        one = (distinct & np.uint64(7)) == 0
        figures = [int(sums[0][one].sum()), int(sums[1][one].sum()), int(((sums[0] + sums[1])[one] > 0).sum())]
        answer = lambda s: [c.pack(s[back[a:b]]) for a, b in zip(sizes, sizes[1:])] + [None]
        n = t.num_rows
        part = t.column("part")[0].as_py()
        return pa.table({
            "block": pa.array(t.column("block").to_pylist() + [-1], pa.int64()), "part": pa.array([part] * (n + 1), pa.int32()),
            "main": pa.array(answer(sums[0]), pa.binary()), "tune": pa.array(answer(sums[1]), pa.binary()),
            **{k: pa.array([0] * n + [v], pa.int64()) for k, v in zip(("n_main", "n_tune", "n_words"), figures)}})

    sent = blocks.select("block", "roles", "ends", "payload").mapInArrow(send, "part int, block long, keys binary, main binary, tune binary")
    return c.staged(sent.groupBy("part").applyInArrow(
        total, "block long, part int, main binary, tune binary, n_main long, n_tune long, n_words long"), "lm-counts")


def _estimates(b: Block, counts: np.ndarray, n: float, n_docs: float, vocabulary: float):
    """Maximum-likelihood estimates by order (uniform first) and the count of the longest history."""
    at = counts[b.back].reshape(b.order, b.size)
    shares = [np.full(b.size, 1 / (vocabulary + 1)), at[0] / max(n, 1.0)]
    history = np.full(b.size, n)
    for k in range(1, b.order):
        history = np.empty(b.size)
        history[1:] = at[k - 1][:-1]
        history[b.begins] = n_docs
        shares.append(np.where(history > 0, at[k] / np.maximum(history, 1), 0.0))
    return shares, history, at[0]


def _bucket(history: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(history + 1)), BUCKETS - 1).astype(np.int64)


def _answers(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(answers.select(["part", "main", "tune"]).to_pylist(), key=lambda r: r["part"])
    return tuple(np.concatenate([c.unpack(r[k], np.uint64) for r in rows]).astype(float) for k in ("main", "tune"))


def _weights(blocks: DataFrame, counts: DataFrame, figures: dict, order: int) -> np.ndarray:
    """Mixture weights (bucket x order) by expectation-maximisation on the tuning blocks."""

    def cells(_, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            b = Block(np.array(row["ends"]), row["payload"], order)
            main, _ = _answers(right)
            shares, history, _ = _estimates(b, main, figures["n_main"], figures["docs_main"], figures["n_words"])
            code = _bucket(history)
            for s in shares[1:]:  # 0: impossible; else the cell of the log
                cell = np.where(s > 0, 1 + np.floor(-np.log2(np.maximum(s, 1e-15)) / STEP), 0).astype(np.int64)
                code = code * 256 + np.minimum(cell, 255)
            found.append(code)
        values, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"cell": values, "n": n.astype(np.int64)})

    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    if not figures["n_tune"]:
        return weights
    tuned = blocks.where("tune").select("block", "ends", "payload")
    mine = counts.join(tuned.select("block"), "block", "left_semi").select("block", "part", "main", "tune")
    rows = tuned.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # BUCKETS * 256^ORDER at most
    code, n = np.array([r["cell"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
    shares = []
    for _ in range(order):
        cell = code % 256
        shares.append(np.where(cell > 0, 2.0 ** (-(cell - 0.5) * STEP), 0.0))
        code = code // 256
    shares = np.stack([np.full(len(n), 1 / (figures["n_words"] + 1)), *shares[::-1]], axis=1)
    for _ in range(ROUNDS):
        mass = weights[code] * shares
        mass *= (n / mass.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(code, mass[:, k], BUCKETS) for k in range(order + 1)], axis=1) + 1e-3
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    c.tuned(docs.sparkSession)
    blocks = _blocks(docs)
    size = blocks.agg(F.coalesce(F.sum(F.element_at("ends", -1)), F.lit(0))).first()[0]
    counts = _count(blocks, order, max(1, -(-size // PART_BYTES)))
    sums = counts.where("block = -1").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n_main", "n_tune", "n_words")]).first().asDict()
    roles = blocks.select(F.explode("roles").alias("r")).groupBy("r").count().collect()
    by_role = {r["r"]: r["count"] for r in roles}
    figures = {k: float(v) for k, v in sums.items()} | {"docs_main": float(by_role.get(_MAIN, 0))}
    figures["docs"] = figures["docs_main"] + by_role.get(_TUNE, 0)
    figures["n"] = figures["n_main"] + figures["n_tune"]
    weights = _weights(blocks, counts, figures, order)
    # Histories that were never seen say nothing about the next token.
    unseen = weights[0].copy()
    if order > 1:
        unseen[-1] = 0.0
        weights[0] = unseen / unseen.sum()

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Block(np.array(row["ends"]), row["payload"], order)
            main, tune = _answers(right)
            shares, history, seen = _estimates(b, main + tune, figures["n"], figures["docs"], figures["n_words"])
            mix = weights[_bucket(history)]
            p = sum(mix[:, k] * s for k, s in enumerate(shares))
            docs_here = len(row["ends"])
            total = lambda x: np.bincount(b.doc, x, docs_here)
            base = np.log10((seen + 0.5) / (figures["n"] + 0.5 * (figures["n_words"] + 1)))
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": np.array(row["roles"]) == _HELD_OUT,
                "n_tokens": b.n_tokens.astype(np.int64), "n_known": total(seen > 0).astype(np.int64),
                "train_tokens": np.full(docs_here, int(figures["n"]), np.int64), "base_score": total(base), "score": total(np.log10(p))}))
        return pa.concat_tables(out)

    return blocks.select("block", "doc_ids", "roles", "ends", "payload").groupBy("block").cogroup(
        counts.where("block >= 0").select("block", "part", "main", "tune").groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(c.table(spark, sf_dir, "documents"))
