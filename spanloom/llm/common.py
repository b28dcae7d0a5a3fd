"""Helpers of this subpackage: staged tables, text chunks, token tables and hashes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import is_local, ship

CHUNK = 2 << 20  # text bytes that one numpy pass works on
LONG_SPAN = 1 << 16  # longer spans are hashed one by one

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


# ---- session and staged tables

def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded size, so that a batch of long texts still fits a Python worker; workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


_OWN: dict[str, str] = {}  # folder of each local application that names none


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session without one gets its own; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="run-")
        _OWN[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of plans that run inside go when each plan ends; else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_flags(docs: DataFrame, flags: DataFrame, key: str = "doc_id", limit: int = 1_000_000) -> DataFrame:
    """``docs`` left-joined to ``flags`` (one row per key); broadcast only up to ``limit`` counted rows."""
    with released(docs.sparkSession):
        small = flags.limit(limit + 1).count() <= limit
    return docs.join(F.broadcast(flags) if small else flags, key, "left")


MARKS = 1 << 27  # bits of a broadcast bitmap at most


def marked(rows: DataFrame, keys: DataFrame, count: int, how: str = "left_semi") -> DataFrame:
    """Rows whose ``key`` may be one of ``count`` keys (``left_anti``: is none of them), by a broadcast bitmap of hashed keys."""
    bits = min(MARKS, max(1 << 15, 1 << (32 * count).bit_length()))
    place = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(bits))
    marks = keys.select(place.alias("_p")).groupBy(F.expr("_p div 32768").alias("_block")).agg(F.bitmap_construct_agg(F.expr("_p % 32768")).alias("_bits"))
    hit = "_p div 32768 = _block and shiftright(int(conv(hex(substring(_bits, int(_p % 32768 div 8) + 1, 1)), 16, 10)), int(_p % 8)) & 1 = 1"
    return rows.withColumn("_p", place).join(F.broadcast(marks), F.expr(hit), how).drop("_p")


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def gapless(df: DataFrame, group: list[str], order: list[str], name: str, blocks: int) -> DataFrame:
    """Adds ``name``: 0, 1, … inside each group, without gaps, in order of (hash block, ``order``).

    A group is cut into ``blocks`` hash blocks; each block is numbered on its own and starts where the
    blocks before it end, so a group of any size is many tasks. ``order`` must tell all rows apart but
    equal ones.
    """
    cut = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    ahead = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    numbered = cut.withColumn("_row", F.row_number().over(inside))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_block") == F.col("_b")]
    return numbered.join(starts, on).withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long")).drop(
        "_block", "_row", "_start", "_b", *[f"_g{i}" for i in range(len(group))])


def crc_of_id(key: Column | str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")))


# ---- chunks of texts

def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with about ``limit`` bytes of text each, at least one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null gives empty bytes."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


# ---- hashes

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES = {seed: np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64) for seed in (1, 2)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all input bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """Hash of a sequence of 64-bit values, position by position over arrays."""
    out = mix(parts[0] + np.uint64(0x632BE59BD9B4E019))
    for p in parts[1:]:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
    return out


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of data[start:end] for ordered spans that do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    sizes = ends - starts
    long = np.flatnonzero(sizes > LONG_SPAN)
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes(), seed)
    short = np.flatnonzero(sizes <= LONG_SPAN)
    values, piece = _TABLES[seed], 1 << 18
    at = 0
    while at < len(short):
        first = starts[short[at]]
        to = max(at + 1, int(np.searchsorted(ends[short], first + piece, "right")))
        mine = short[at:to]
        sub = data[first:ends[mine[-1]]]
        up, down = _powers(len(sub) + 1)
        total = np.zeros(len(sub) + 1, np.uint64)
        np.cumsum(values[sub] * up[:len(sub)], out=total[1:])
        s, e = starts[mine] - first, ends[mine] - first
        out[mine] = mix((total[e] - total[s]) * down[s] + sizes[mine].astype(np.uint64))
        at = to
    return out


# ---- tokens

@dataclass
class Tokens:
    """Tokens of several documents: byte spans in ``data``, hash and document number of each."""

    data: np.ndarray
    doc_start: np.ndarray  # first byte of each document
    doc_end: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first token of each document, with the total at the end
    doc: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def tokens(docs: list[bytes], breaks: np.ndarray = SPACE, lower: bool = False, hashed: bool = True) -> Tokens:
    """Maximal runs of bytes that are no breaks. ``breaks`` must hold the line feed; lower maps A-Z only."""
    joined = b"\n".join(docs) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    doc_end = np.cumsum(sizes + 1) - 1
    doc_start = doc_end - sizes
    inside = ~breaks[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    first = np.concatenate((np.searchsorted(starts, doc_start), [len(starts)]))
    hashes = span_hash(data, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Tokens(data, doc_start, doc_end, starts, ends, hashes, first, np.repeat(np.arange(len(docs)), np.diff(first)))


def lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines of text that ends with a line feed."""
    ends = np.flatnonzero(data == 10)
    return np.concatenate(([0], ends[:-1] + 1)), ends


def running(flags: np.ndarray) -> np.ndarray:
    """Counts of true values before each position, with the total at the end."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def in_doc(doc: np.ndarray, size: int) -> np.ndarray:
    """Positions i at which tokens i … i+size-1 belong to one document."""
    if len(doc) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[:len(doc) - size + 1] == doc[size - 1:])


def table_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


# ---- packed arrays and sorted groups

def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes; sorted or small values take little room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(blob[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def by_key(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by non-null integer ``keys``, one after another."""
    held: list[pa.Table] = []
    last = None

    def bounds(t):
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.logical_or.reduce([x[1:] != x[:-1] for x in cols])
        return np.concatenate(([0], np.flatnonzero(new) + 1, [t.num_rows])), tuple(x[0] for x in cols), tuple(x[-1] for x in cols)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        at, first, end = bounds(t)
        if held and first != last:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        for a, b in zip(at[:-2], at[1:-1]):
            yield pa.concat_tables([*held, t.slice(a, b - a)]).combine_chunks()
            held = []
        held.append(t.slice(at[-2]))
        last = end
    if held:
        yield pa.concat_tables(held).combine_chunks()
