"""Approximate nearest neighbours by largest inner product: a hash-prefix forest of sorted arrays.

Index. Equal vectors are one class, known by a 128-bit hash, with its smallest ids. Classes of one length and one band of norms (a factor of
two, counted from the largest) form a space; inside a space vectors are centred, scaled by the largest distance and lifted to the unit sphere by one more
coordinate, so that a larger inner product is a smaller angle. In each of ``TREES`` trees a class has a string of ``CHARS`` characters: a character is the direction
that is largest in absolute value among ``WIDTH`` random ones, with its sign (2 * WIDTH letters). All strings are written as one array sorted by
(space, tree, string), with 16-bit codes of the vectors; a prefix is a range of positions in it.

Search. A query descends in every tree to its longest prefix that is heavy (at least 1 / ``HEAVY`` of the space; the driver holds the ranges
of these alone, at most HEAVY a tree and length), then all trees ascend together: a character shorter in each step, and at the first
character to the query's next best letters one by one, until the ranges of all trees hold ``SHARE`` of the space (``LEAST`` entries at least); beyond the last letter
stands the whole space. The array of a space is cut into ``SEGMENTS`` segments and the queries of a segment into parts of about ``ASKED``; a task holds its queries
and streams the entries of its segment past them, so its memory does not grow with the segment, and a query gets at most ``KEEP`` entries from each segment. Tasks
score by codes; the best ``RESCORED`` classes of a query are scored anew in double precision on the original vectors, its own class always among them, and become rows by their ids.

``SHARE`` decides recall: vectors without structure (the tables here) need most of the space for 0.9, clustered ones a small part. Nothing is cut inside a
range, and no bucket has a cap.

Queries are the rows whose vec_id is divisible by ``EVERY``. Vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows without vec_id. Vectors of other lengths are no candidates of each other. A repeated vec_id is a row of its own: a query leaves out one row of its class
with its id, and repeated query rows give repeated results. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as c

EVERY = 20
NEAREST = 20
TREES = 6
WIDTH = 16
CHARS = 6
HEAVY = 1024
SHARE = 0.8
LEAST = 4096
SEGMENTS = 12  # of each space; tasks are SEGMENTS x parts of the queries
ASKED = 8192  # queries of one task
KEEP = 40
RESCORED = 60
SEED = 13
LETTERS = 2 * WIDTH


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, vector and class key of the rows that take part."""
    dims = F.col("embedding")
    usable = (F.size(dims) > 0) & ~F.exists(dims, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(dims, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & dims.isNotNull()).where(usable)
    plain = F.transform(dims.cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one value
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("v")).select(
        "vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def _classes(rows: DataFrame) -> DataFrame:
    """A row for each distinct vector: its number, ids of the first NEAREST + 1 rows, whether a query is among its rows."""
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= NEAREST + 1)
    both = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    asking = rows.where(F.col("vec_id") % EVERY == 0).select("h1", "h2", F.lit(True).alias("asking")).distinct()
    both = both.join(asking, ["h1", "h2"], "left").withColumn("asks", F.coalesce("asking", F.lit(False)))
    largest = F.array_max(F.transform("v", F.abs))
    norm = largest * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / largest) * (x / largest)))
    return c.staged(both.select(
        F.xxhash64("h1", "h2").alias("cls"), "h1", "h2", "v", "ids", "asks", F.size("v").alias("dim"), norm.alias("norm")), "neighbour-classes")


@dataclass
class Space:
    """The classes of one length and one band of norms: their number, mean and largest distance from it."""

    dim: int
    band: int
    n: int
    mean: np.ndarray
    top: float
    segments: int

    @property
    def length(self) -> int:
        """Positions in one segment."""
        return -(-self.n * TREES // self.segments)

    def lift(self, v: np.ndarray) -> np.ndarray:
        at = (v - self.mean) / (self.top or 1.0)
        rest = np.sqrt(np.maximum(0.0, 1.0 - (at * at).sum(axis=1, keepdims=True)))
        return np.concatenate([at, rest], axis=1)


def _banded(classes: DataFrame) -> DataFrame:
    """The classes with their band: how often the largest norm of the length halves to theirs."""
    tops = classes.groupBy("dim").agg(F.max("norm").alias("top")).withColumnRenamed("dim", "d")
    return classes.join(F.broadcast(tops), F.col("dim") == F.col("d")).withColumn("band", F.floor(F.log2("top") - F.log2("norm"))).drop("d", "top")


def _groups(batch: pa.RecordBatch):
    """Rows of a batch by (length, band): keys, row numbers, vectors."""
    sizes, bands = batch.column("dim").to_numpy(), batch.column("band").to_numpy()
    for d, b in sorted(set(zip(sizes.tolist(), bands.tolist()))):
        some = np.flatnonzero((sizes == d) & (bands == b))
        yield (d, b), some, _matrix(batch.column("v").take(pa.array(some)))


def _spaces(banded: DataFrame) -> list[Space]:
    """The spaces; the driver sees one vector and one number each."""

    def sums(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, _, v in _groups(batch):
                part = np.concatenate([[len(v)], v.sum(axis=0)])
                held[key] = held[key] + part if key in held else part
        for (d, b), part in held.items():
            n = len(part)
            yield pa.RecordBatch.from_pydict({"dim": np.full(n, d, np.int32), "band": np.full(n, b), "at": np.arange(n, dtype=np.int32), "x": part})

    slim = banded.select("dim", "band", "v")
    found: dict[tuple[int, int], dict[int, float]] = {}
    kinds = "dim int, band long, at int, x double"
    for r in slim.mapInArrow(sums, kinds).groupBy("dim", "band", "at").agg(F.sum("x").alias("x")).collect():
        found.setdefault((r["dim"], r["band"]), {})[r["at"]] = r["x"]
    means = {key: np.array([x[k] for k in range(1, key[0] + 1)]) / x[0] for key, x in found.items()}

    def reach(batches):
        for batch in batches:
            for (d, b), _, v in _groups(batch):
                yield pa.RecordBatch.from_pydict({"dim": [d], "band": [b], "x": [float(np.linalg.norm(v - means[d, b], axis=1).max())]},
                                                 schema=pa.schema([("dim", pa.int32()), ("band", pa.int64()), ("x", pa.float64())]))

    tops = {(r["dim"], r["band"]): r["x"] for r in slim.mapInArrow(reach, "dim int, band long, x double").groupBy("dim", "band").agg(F.max("x").alias("x")).collect()}
    return [Space(*key, int(found[key][0]), means[key], tops[key], SEGMENTS) for key in sorted(found)]


def _letters(dim: int, tree: int, lifted: np.ndarray) -> np.ndarray:
    """Projections for each character and letter: rows x CHARS x LETTERS; letters are directions and their opposites."""
    rng = np.random.default_rng([SEED, dim, tree])
    lines = rng.normal(size=(dim + 1, CHARS * WIDTH))
    if dim + 1 >= WIDTH:  # directions of one character are orthogonal where there is room
        lines = np.concatenate([np.linalg.qr(lines[:, k * WIDTH:(k + 1) * WIDTH])[0] for k in range(CHARS)], axis=1)
    y = (lifted @ lines).reshape(len(lifted), CHARS, WIDTH)
    return np.concatenate([y, -y], axis=2)


def _strings(chars: np.ndarray) -> np.ndarray:
    """Characters as one number, first character highest."""
    return chars.astype(np.int64) @ (LETTERS ** np.arange(CHARS - 1, -1, -1, dtype=np.int64))


def _sorted_array(banded: DataFrame, spaces: list[Space]) -> DataFrame:
    """The entries of all trees in one sorted order, numbered without gaps inside each range of it."""
    at = {(s.dim, s.band): k for k, s in enumerate(spaces)}

    def hashed(batches):
        for batch in batches:
            for key, some, v in _groups(batch):
                k, n = at[key], len(some)
                cls, lifted, (codes, step) = batch.column("cls").take(pa.array(some)), spaces[at[key]].lift(v), _codes(v)
                for tree in range(TREES):
                    string = _strings(_letters(key[0], tree, lifted).argmax(axis=2))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(string), cls, pa.array(step), pa.array(codes, pa.binary())],
                        names=["space", "tree", "string", "cls", "step", "code"])

    keys = ["space", "tree", "string", "cls"]
    entries = banded.select("dim", "band", "v", "cls").mapInArrow(hashed, "space int, tree int, string long, cls long, step float, code binary")

    def numbered(batches):
        at = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    dealt = entries.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id())
    kinds = "space int, tree int, string long, cls long, step float, code binary, range int, place long"
    return c.staged(dealt.mapInArrow(numbered, kinds), "neighbour-array")


def _codes(v: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Vectors as signed 16-bit numbers with one step each."""
    largest = np.abs(v).max(axis=1)
    return [row.tobytes() for row in np.rint(v / largest[:, None] * 32767).astype("<i2")], (largest / 32767).astype(np.float32)


@dataclass
class Directory:
    """Ranges of the heavy prefixes of every space and tree: per length sorted prefixes with first and last position."""

    levels: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]

    def ranges(self, space: int, tree: int, size: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First position and length of each prefix; length 0 for one that is not heavy."""
        names, lows, counts = self.levels.get((space, tree, size), (np.zeros(0, np.int64),) * 3)
        if not len(names):
            return np.zeros(len(prefix), np.int64), np.zeros(len(prefix), np.int64)
        k = np.minimum(np.searchsorted(names, prefix), len(names) - 1)
        hit = names[k] == prefix
        return np.where(hit, lows[k], 0), np.where(hit, counts[k], 0)


def _directory(entries: DataFrame, spaces: list[Space]) -> Directory:
    """Counts by prefix, kept where the parent is heavy: at most LETTERS * HEAVY numbers a space, tree and length."""
    levels: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    start, begin = 0, {}
    for k, s in enumerate(spaces):
        for tree in range(TREES):
            begin[k, tree] = start
            start += s.n
    least = {k: max(1, s.n // HEAVY) for k, s in enumerate(spaces)}
    strings = c.staged(entries.groupBy("space", "tree", "string").agg(F.count(F.lit(1)).alias("n")), "neighbour-strings")
    floor = F.coalesce(*[F.when(F.col("space") == k, n) for k, n in least.items()])
    for size in range(1, CHARS + 1):
        cut = LETTERS ** (CHARS - size)
        counts = strings.groupBy("space", "tree", F.floor(F.col("string") / cut).alias("prefix")).agg(F.sum("n").alias("n"))
        if size > 1:  # light children of heavy parents are needed for the positions of the others
            parent = F.floor(F.col("string") / (cut * LETTERS))
            heavy = strings.groupBy("space", "tree", parent.alias("parent")).agg(F.sum("n").alias("m")).where(F.col("m") >= floor).drop("m")
            counts = counts.withColumn("parent", F.floor(F.col("prefix") / LETTERS)).join(heavy, ["space", "tree", "parent"], "left_semi").drop("parent")
        grouped: dict[tuple[int, int], list] = {}
        for r in counts.select("space", "tree", "prefix", "n").collect():
            grouped.setdefault((r["space"], r["tree"]), []).append((r["prefix"], r["n"]))
        if not grouped:
            break
        for (k, tree), pairs in grouped.items():
            names, ns = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
            if size == 1:
                lows = begin[k, tree] + np.cumsum(ns) - ns
            else:
                up_names, up_lows, _ = levels[k, tree, size - 1]
                up = names // LETTERS
                first = np.concatenate(([True], up[1:] != up[:-1]))
                before = np.cumsum(ns) - ns
                lows = up_lows[np.searchsorted(up_names, up)] + before - np.maximum.accumulate(np.where(first, before, 0))
            some = np.ones(len(ns), bool) if size == 1 else ns >= least[k]
            levels[k, tree, size] = (names[some], lows[some], ns[some])
    c.drop_staged(strings)
    return Directory(levels)


def _asked(queries: DataFrame, spaces: list[Space], directory: Directory, share: float) -> DataFrame:
    """(query, segment, ranges) after the trees have ascended together."""
    of_dim: dict[int, list[int]] = {}
    for k, s in enumerate(spaces):
        of_dim.setdefault(s.dim, []).append(k)
    begin = np.cumsum([0] + [s.n * TREES for s in spaces])

    def ascend(v: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ranges of each query: lows and ends."""
        s = spaces[k]
        n, need = len(v), min(max(share * s.n, LEAST), s.n * TREES)
        toward = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((n, 1))], axis=1)
        lows, counts = np.zeros((n, TREES, CHARS), np.int64), np.zeros((n, TREES, CHARS), np.int64)
        other = np.zeros((2, n, TREES, LETTERS), np.int64)
        for tree in range(TREES):
            y = _letters(s.dim, tree, toward)
            string = _strings(y.argmax(axis=2))
            for size in range(1, CHARS + 1):
                lows[:, tree, size - 1], counts[:, tree, size - 1] = directory.ranges(k, tree, size, string // LETTERS ** (CHARS - size))
            letters = np.argsort(-y[:, 0], axis=1, kind="stable")
            found = directory.ranges(k, tree, 1, letters.ravel())
            other[0, :, tree], other[1, :, tree] = (x.reshape(n, LETTERS) for x in found)
        deep = counts.sum(axis=1)[:, ::-1]  # CHARS ... 1 characters
        wide = np.cumsum(other[1].sum(axis=1), axis=1)  # 1 ... LETTERS letters
        ladder = np.concatenate([deep[:, :-1], wide], axis=1)
        step = (ladder < need).sum(axis=1) if CHARS > 1 else (wide < need).sum(axis=1)
        out = []
        for i in range(n):
            if step[i] < CHARS - 1:
                size = CHARS - 1 - step[i]
                low, count = lows[i, :, size], counts[i, :, size]
            else:
                letters = step[i] - CHARS + 2
                if letters >= LETTERS:  # all letters of all trees: one tree holds the space
                    low, count = np.array([begin[k]]), np.array([s.n])
                else:
                    low, count = other[0, i, :, :letters].ravel(), other[1, i, :, :letters].ravel()
            some = count > 0
            order = np.argsort(low[some])
            out.append((low[some][order], (low + count)[some][order]))
        return out

    schema = pa.schema([("query", pa.int64()), ("segment", pa.int64()), ("step", pa.float32()), ("code", pa.binary()), ("lows", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for d in np.unique(sizes):
                mine = np.flatnonzero(sizes == d)
                v, cls = _matrix(batch.column("v").take(pa.array(mine))), batch.column("cls").take(pa.array(mine)).to_pylist()
                rows, (codes, steps) = [], _codes(v)
                for k in of_dim[int(d)]:
                    for q, step, code, (lows, ends) in zip(cls, steps.tolist(), codes, ascend(v, k)):
                        by: dict[int, tuple[list[int], list[int]]] = {}
                        start, length = int(begin[k]), spaces[k].length
                        for low, end in zip(lows.tolist(), ends.tolist()):
                            for i in range((low - start) // length, (end - 1 - start) // length + 1):
                                x, y = by.setdefault(k * spaces[k].segments + i, ([], []))
                                low_in, end_in = max(low, start + i * length), min(end, start + (i + 1) * length)
                                if y and y[-1] == low_in:
                                    y[-1] = end_in
                                else:
                                    x.append(low_in)
                                    y.append(end_in)
                        rows += [(q, segment, step, code, x, y) for segment, (x, y) in by.items()]
                if rows:
                    yield c.table_of(schema, *zip(*rows))

    return c.staged(queries.select("cls", "dim", "v").mapInArrow(run, "query long, segment long, step float, code binary, lows array<long>, ends array<long>"), "neighbour-ranges")


class _Running:
    """The queries of one task and the best KEEP entries of each so far."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.asked = None

    def ask(self, t: pa.RecordBatch) -> None:
        self.rows += zip(*(t.column(k).to_pylist() for k in ("query", "code", "step", "lows", "ends")))

    def _start(self) -> None:
        codes = np.frombuffer(b"".join(r[1] for r in self.rows), "<i2").reshape(len(self.rows), -1)
        self.asked = codes.astype(np.float32) * np.array([r[2] for r in self.rows], np.float32)[:, None]
        self.lows, self.ends = ([np.array(r[k], np.int64) for r in self.rows] for k in (3, 4))
        self.score = np.full((len(self.rows), KEEP), -np.inf, np.float32)
        self.cls = np.zeros((len(self.rows), KEEP), np.int64)

    def meet(self, t: pa.RecordBatch) -> None:
        """Score a run of entries, in order of their places, for the queries that ask for any of them."""
        if not self.rows:
            return
        if self.asked is None:
            self._start()
        place, names = t.column("place").to_numpy(), t.column("cls").to_numpy()
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), "<i2").reshape(len(place), -1)
        entry = codes.astype(np.float32) * t.column("step").to_numpy()[:, None]
        spans = [(np.searchsorted(place, a), np.searchsorted(place, b)) for a, b in zip(self.lows, self.ends)]
        some = np.flatnonzero([bool((b > a).any()) for a, b in spans])
        for at in range(0, len(some), 512):
            mine = some[at:at + 512]
            near = self.asked[mine] @ entry.T
            edge = np.zeros((len(mine), len(place) + 1), np.int8)
            for i, q in enumerate(mine):
                a, b = spans[q]
                np.add.at(edge[i], a, 1)
                np.add.at(edge[i], b, -1)
            near[np.cumsum(edge, axis=1, dtype=np.int8)[:, :-1] == 0] = -np.inf
            better = np.flatnonzero((near > self.score[mine].min(axis=1)[:, None]).any(axis=1))
            if len(better):
                q = mine[better]
                score = np.concatenate([self.score[q], near[better]], axis=1)
                cls = np.concatenate([self.cls[q], np.broadcast_to(names, (len(q), len(names)))], axis=1)
                top = np.argpartition(-score, KEEP - 1, axis=1)[:, :KEEP]
                self.score[q], self.cls[q] = np.take_along_axis(score, top, axis=1), np.take_along_axis(cls, top, axis=1)

    def found(self, schema: pa.Schema) -> pa.RecordBatch | None:
        if self.asked is None:
            return None
        ok = np.isfinite(self.score)
        who = np.repeat(np.array([r[0] for r in self.rows], np.int64), ok.sum(axis=1))
        return c.table_of(schema, who, self.cls[ok], self.score[ok])


def _best(batches):
    """Streams segments past the queries of their parts; the best KEEP of each query."""
    schema = pa.schema([("query", pa.int64()), ("cls", pa.int64()), ("near", pa.float32())])
    held, running = None, _Running()
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("segment", "part", "entry")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            task = (keys[a, 0], keys[a, 1])
            if task != held:
                out = running.found(schema)
                if out is not None:
                    yield out
                held, running = task, _Running()
            (running.meet if keys[a, 2] else running.ask)(batch.slice(a, b - a))
    out = running.found(schema)
    if out is not None:
        yield out


def _candidates(classes: DataFrame, entries: DataFrame, asked: DataFrame, spaces: list[Space]) -> DataFrame:
    """(query, cls) of the RESCORED classes with the best codes, and the query's own class."""
    first = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = entries.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("ahead"))
    begin = np.cumsum([0] + [s.n * TREES for s in spaces]).tolist()
    segment = F.coalesce(*[F.when(F.col("space") == k, k * s.segments + F.floor((F.col("at") - begin[k]) / s.length)) for k, s in enumerate(spaces)])
    placed = entries.join(F.broadcast(ranges), "range").withColumn("at", F.col("place") + F.col("ahead")).withColumn("segment", segment)
    parts = asked.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))  # one row a segment
    held = placed.join(F.broadcast(parts), "segment").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = asked.join(F.broadcast(parts), "segment").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    keys = ["segment", "part"]
    tasks = held.select(*keys, F.lit(1).alias("entry"), F.col("at").alias("place"), "cls", "step", "code").unionByName(
        sent.select(*keys, F.lit(0).alias("entry"), "query", "step", "code", "lows", "ends"), allowMissingColumns=True)
    tasks = tasks.repartition(*keys).sortWithinPartitions(*keys, "entry", "place")
    found = tasks.mapInArrow(_best, "query long, cls long, near float")
    best = found.groupBy("query", "cls").agg(F.max("near").alias("near"))
    rank = Window.partitionBy("query").orderBy(F.desc("near"), "cls")
    best = best.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= RESCORED).select("query", "cls")
    itself = classes.where("asks").select(F.col("cls").alias("query"), "cls")
    return c.staged(best.unionByName(itself).distinct(), "neighbour-candidates")


def _scored(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each query class the best NEAREST + 1 rows, nearest first: score, vec_id, whether it is a row of the class itself."""
    slim = classes.select("cls", "v", "ids")
    asking = classes.where("asks").select(F.col("cls").alias("query"), F.col("v").alias("w"))

    def exact(batches):
        for batch in batches:
            v, w = batch.column("v"), batch.column("w")
            sizes = np.asarray(v.value_lengths())
            score = np.zeros(batch.num_rows)
            for d in np.unique(sizes):
                some = np.flatnonzero(sizes == d)
                x, y = (_matrix(k.take(pa.array(some))) for k in (v, w))
                score[some] = (x * y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("cls"), batch.column("ids"), pa.array(score)], names=["query", "cls", "ids", "score"])

    met = pairs.join(slim, "cls").join(asking, "query").select("query", "cls", "ids", "v", "w")
    scored = met.mapInArrow(exact, "query long, cls long, ids array<long>, score double")
    rows = scored.select("query", (F.col("cls") == F.col("query")).alias("own"), "score", F.explode("ids").alias("vec_id"))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= NEAREST + 1)
    return top.groupBy("query").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("r", "score", "vec_id", "own"))), lambda x: F.struct(x["score"], x["vec_id"], x["own"])).alias("near"))


def search(vectors: DataFrame, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query."""
    spark = c.tuned(vectors.sparkSession)
    rows = _rows(vectors)
    classes = _classes(rows)
    banded = _banded(classes)
    spaces = _spaces(banded)
    if not spaces:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = _sorted_array(banded, spaces)
    asked = _asked(classes.where("asks"), spaces, _directory(entries, spaces), share)
    pairs = _candidates(classes, entries, asked, spaces)
    c.drop_staged(entries, asked)
    near = _scored(classes, pairs)
    of = classes.where("asks").join(near, F.col("cls") == F.col("query")).select("h1", "h2", "near")
    asks = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    got = asks.join(of, ["h1", "h2"]).drop("h1", "h2")
    itself = F.array_position(F.transform("near", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.filter("near", lambda x, i: i + 1 != F.col("itself"))
    return got.withColumn("itself", itself).select("query_id", F.posexplode(F.slice(others, 1, NEAREST)).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op13_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(c.table(spark, sf_dir, "embeddings"))
