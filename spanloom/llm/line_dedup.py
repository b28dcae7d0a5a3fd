"""Line dedup: range-partitioned line hashes, streamed in order, give per-document keep bitmaps.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points that occur in at least ``MIN_DOCS`` documents lose all their lines except those of the
largest document holding it. Keys are hashed (128 bits) and range-partitioned by (hash, document,
position) with a secondary sort, so that the lines of one key spread over as many tasks as they need.
Each task streams its keys once; only the first and last key of a task can go on elsewhere, and their
rows are settled by a partially aggregated count. Documents get their dropped positions as a
compressed keep bitmap; text is never exchanged with the lines.

Null and empty texts are one empty line, which stays. A document is known by its id: rows with equal
ids count as one document, a null id counts as one that is smaller than all others. Repeated rows get
equal bitmaps. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

MIN_CHARS = 20
MIN_DOCS = 3
OPEN_ROWS = 1 << 16  # rows of one key that a task holds before leaving them to the count
_KEYS = ["h1", "h2", "doc_id", "text_hash", "pos"]


def line_keys(docs: DataFrame) -> DataFrame:
    """A row for each line whose key is long enough: 128-bit hash, document and position."""

    def run(batches):
        for batch in c.chunks(batches):
            t = c.tokens(c.as_bytes(batch.column(1)), lower=True, hashed=False)
            start, end = c.lines(t.data)
            owner = np.searchsorted(t.doc_start, start, "right") - 1
            pos = np.arange(len(start)) - np.searchsorted(start, t.doc_start)[owner]
            a, b = np.searchsorted(t.starts, start), np.searchsorted(t.starts, end)
            some = np.flatnonzero(b > a)
            lo, hi = t.starts[a[some]], t.ends[b[some] - 1]
            points = c.running((t.data & 0xC0) != 0x80)
            long = points[hi] - points[lo] >= MIN_CHARS
            some, lo, hi = some[long], lo[long], hi[long]
            who = pa.array(owner[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.span_hash(t.data, lo, hi, 1).view(np.int64)), pa.array(c.span_hash(t.data, lo, hi, 2).view(np.int64)),
                 batch.column(0).take(who), batch.column(2).take(who), pa.array(pos[some].astype(np.int32))], names=_KEYS)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "h1 long, h2 long, doc_id long, text_hash long, pos int")


def _stream(batches):
    """Rows to drop (settled) and rows of keys that may go on in another task (not settled)."""
    held: list[pa.Table] = []  # rows of the key that the last batch ended with
    first = True  # no key has ended yet in this task
    forced = None  # a key too long to hold: all its rows are left open

    def rows(t: pa.Table, open_: np.ndarray, drop: np.ndarray):
        pick = np.flatnonzero(open_ | drop)
        return t.take(pa.array(pick)).append_column("settled", pa.array(~open_[pick])).to_batches()

    def decide(t: pa.Table, last: bool):
        nonlocal first, forced
        h1, h2 = (t.column(k).to_numpy() for k in ("h1", "h2"))
        doc = t.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        group = np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        docs = np.bincount(group, other)
        starts = np.flatnonzero(new)
        top = np.maximum.reduceat(doc, starts)
        open_ = np.zeros(len(starts), bool)
        open_[0] |= first or forced == (h1[0], h2[0])
        open_[-1] |= last
        first, forced = False, None
        drop = (docs >= MIN_DOCS)[group] & (doc != top[group])
        return rows(t, open_[group], drop & ~open_[group])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.concat_tables([*held, pa.Table.from_batches([batch])])
        h1, h2 = t.column("h1").to_numpy(), t.column("h2").to_numpy()
        same = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield from decide(t.slice(0, cut), False)
        rest = t.slice(cut)
        if rest.num_rows > OPEN_ROWS:
            yield from rows(rest, np.ones(rest.num_rows, bool), np.zeros(rest.num_rows, bool))
            forced, held = (h1[-1], h2[-1]), [rest.slice(0, 0)]
        else:
            held = [rest]
    t = pa.concat_tables(held) if held else None
    if t is not None and t.num_rows:
        yield from decide(t, True)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos) of every line that goes."""
    keys = c.staged(line_keys(docs), "line-keys")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "text_hash", "pos"]
    schema = "h1 long, h2 long, doc_id long, text_hash long, pos int, settled boolean"
    streamed = c.staged(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream, schema), "lines")
    c.drop_staged(keys)
    open_ = streamed.where("not settled")
    per_key = open_.groupBy("h1", "h2", "doc_id").agg(F.lit(1)).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= MIN_DOCS)
    # Written first: Spark can then split a hot key's rows in the join.
    late = open_.join(c.staged(per_key, "open-keys"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    cols = ["doc_id", "text_hash", "pos"]
    return streamed.where("settled").select(cols).unionAll(late.select(cols))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_dropped, keep_bitmap (zlib of packed bits) of documents that lose lines."""
    c.tuned(docs.sparkSession)

    def pack(batches):
        for batch in batches:
            maps, n = [], []
            for pos in batch.column(2).to_pylist():
                bits = np.ones((max(pos) // 8 + 1) * 8, bool)  # whole bytes: lines beyond the last one dropped stay
                bits[pos] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
                n.append(len(pos))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(maps, pa.binary())],
                                             names=["doc_id", "text_hash", "n_dropped", "keep_bitmap"])

    return dropped_lines(docs).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("pos")).mapInArrow(
        pack, "doc_id long, text_hash long, n_dropped long, keep_bitmap binary")


def with_bitmaps(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_line_bitmap`` and ``_line_dropped`` (null where every line stays)."""
    maps = keep_bitmaps(docs).select(F.col("doc_id").alias("_line_id"), F.col("text_hash").alias("_line_hash"),
                                     F.col("n_dropped").alias("_line_dropped"), F.col("keep_bitmap").alias("_line_bitmap"))
    return docs.join(maps, F.col("doc_id").cast("long").eqNullSafe(F.col("_line_id")) & (F.xxhash64("text") == F.col("_line_hash")), "left").drop("_line_id", "_line_hash")


def kept_text(text: bytes, bitmap: bytes | None) -> bytes:
    """The lines that the bitmap keeps; positions beyond the bitmap stay."""
    if bitmap is None:
        return text
    parts = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:len(parts)]
    return b"\n".join(x for i, x in enumerate(parts) if i >= len(bits) or bits[i])


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with kept lines only, all other columns as they were."""
    names = docs.columns
    rest = [n for n in names if n != "text"]
    # The other columns go along as one, so that no name of theirs can clash.
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{n}`") for n in rest]).alias("_row"))

    def run(batches):
        for batch in c.chunks(batches):
            raw, maps = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_line_bitmap").to_pylist()
            text = pa.array([x if x is None or m is None else kept_text(x, m) for x, m in zip(raw, maps)], pa.binary()).cast(pa.string())
            kept = dict(zip(rest, batch.column("_row").flatten()[1:]))
            yield pa.RecordBatch.from_arrays([text if n == "text" else kept[n] for n in names], names=names)

    return with_bitmaps(packed).mapInArrow(run, docs.schema)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        for batch in c.chunks(batches):
            raw, maps = c.as_bytes(batch.column("text")), batch.column("_line_bitmap").to_pylist()
            digest = [hashlib.sha256(kept_text(x, m)).hexdigest() for x, m in zip(raw, maps)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([x.count(b"\n") + 1 for x in raw], pa.int64()),
                 batch.column("_line_dropped").fill_null(0), pa.array(digest, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs).mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
