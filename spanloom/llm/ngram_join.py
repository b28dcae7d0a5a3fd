"""N-gram Jaccard self-join with count-vector R-trees.

A document's set holds its distinct ``WORDS``-word shingles (A-Z lower-cased; with fewer words the whole sequence is one).
Documents with equal sets are one class. Two classes link when 100 * |intersection| >= ``PERCENT`` * |union|.

Shingles are hashed into ``GROUPS`` groups; the counts by group are a class's point. For two points the sum of
coordinate minima bounds the intersection, and for two R-tree nodes the sum of minima of their upper corners does. Points meet
in blocks: linked sets share a shingle among their first |set| - ceil(PERCENT% of |set|) + 1 in a fixed order of shingles, so
there is one block for each such shingle that two classes hold (equal blocks count once). In each block an R-tree is
packed and joined with itself under the bounds; the pairs left are verified on whole texts.

The order puts common shingles last (seen in a sample of one text in ``SAMPLE``; it changes the work, never the result), so a
line or passage of more than about ``BLOCK`` texts makes no block. Members too far apart in size leave a block before it is joined. Blocks that stay large belong to groups of near copies. First every class is joined with its best
earlier partner in each block; a large block is dealt by hash into parts of about ``BLOCK`` classes, and a class goes with one of its large
blocks only. ``ROUNDS`` more rounds deal the large blocks anew, for the best earlier partner in another component. Last, all pairs of
different components are searched: in small blocks that had more candidates than the first search gave, and in the large ones by
pairs of cells. A cell holds about ``BLOCK`` classes of one set size band, of one component where that is larger than a cell; two
cells meet once, if a large block holds classes of both, and not if they are of one component, too far apart in size, or if the bound on their
upper corners leaves no link. Pairs of
cells with many candidates compare whole shingle sets in place, the others give their pairs to the check on texts. A task holds two
cells at a time, whatever the group. Rows grow with classes, except where large components share head shingles: their pairs
of cells grow with the product of their sizes.

Null or empty text: the empty set, linked with nothing. Rows with null id take part, but a component is the smallest non-null id;
if there is none it is null. Repeated rows are one class. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c
from .components import components, forest

WORDS = 4
PERCENT = 85
GROUPS = 256
BLOCK = 256
ROUNDS = 2
WEIGHT = 1 << 20  # shingles in a cell, about
DENSE = 2  # candidates for each class of two cells above which their sets are compared in place
TOLD = 1 << 20  # pairs a task remembers; a pair told twice costs work only
LEAF = 16
TASKS = 16  # of the blocks that share a smallest class
SAMPLE = 32  # one text in so many decides which shingles are common
COMMON = 1 << 18  # common shingles kept, most frequent first
LISTED = 1 << 19  # keys of documents that are broadcast as they are; more go as a bitmap


def _sets(docs: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    t = c.tokens(docs, lower=True)
    at = c.in_doc(t.doc, WORDS)
    full = c.combine(*[t.hashes[at + k] for k in range(WORDS)])
    cut = np.searchsorted(t.doc[at], np.arange(len(docs) + 1))
    out = []
    for i, n in enumerate(t.counts):
        if n >= WORDS:
            out.append(np.unique(full[cut[i]:cut[i + 1]]))
        elif n:
            h = t.hashes[t.first[i]:t.first[i + 1]]
            out.append(c.combine(*h[:, None], np.array([n], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class(s: np.ndarray) -> int:
    """64-bit name of a set."""
    if not len(s):
        return 0
    sums = np.array([s.sum(), c.mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(), len(s)], np.uint64)
    return int(c.combine(*sums[:, None]).view(np.int64)[0])


def _point(s: np.ndarray) -> bytes:
    """Counts of a set by group: one byte each if they fit, else four."""
    counts = np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return counts.astype("<u4" if counts.max() > 255 else "u1").tobytes()


def _matrix(points: list[bytes]) -> np.ndarray:
    """Points of a block as rows, in the narrowest kind that holds them all."""
    if all(len(x) == GROUPS for x in points):
        return np.frombuffer(b"".join(points), "u1").reshape(-1, GROUPS)
    return np.stack([np.frombuffer(x, "u1" if len(x) == GROUPS else "<u4").astype("<u4") for x in points])


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that by a sample of the texts are in more than about ``BLOCK`` of them, however many texts there are."""

    def run(batches):
        for batch in c.chunks(batches):
            flat = np.concatenate(_sets(c.as_bytes(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["h"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(SAMPLE)) == 0).distinct()
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    most = counts.where(F.col("n") >= max(8, BLOCK // SAMPLE)).orderBy(F.desc("n"), "h").limit(COMMON)
    with c.released(docs.sparkSession):
        found = most.select("h").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def _points(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, n, class, counts by group and the shingles that name the document's blocks."""

    def run(batches):
        for batch in c.chunks(batches):
            sets = _sets(c.as_bytes(batch.column(1)))
            counts, heads = [], []
            for s in sets:
                n = len(s)
                counts.append(_point(s))
                take = n - (PERCENT * n + 99) // 100 + 1 if n else 0
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    rare = s[~late]
                    s = rare[:take] if len(rare) >= take else np.concatenate((rare, s[late]))[:take]
                heads.append(s[:take].view(np.int64))
            cut = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()),
                 pa.array(counts, pa.binary()), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(heads)))],
                names=["doc_id", "at", "n", "cls", "counts", "head"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("at")).mapInArrow(
        run, "doc_id long, at long, n long, cls long, counts binary, head array<long>")


class RTree:
    """Packed R-tree over count vectors: nodes hold upper corners and the range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple[np.ndarray, int, int, tuple]] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        children: tuple = ()
        if len(rows) > LEAF:
            sub = self.points[rows]
            spread = np.append((sub.max(0) - sub.min(0)).astype(float), np.ptp(self.sizes[rows]) / 4)
            d = int(np.argmax(spread))
            key = self.sizes[rows] if d == sub.shape[1] else sub[:, d]
            rows = rows[np.argsort(key, kind="stable")]
            half = len(rows) // 2
            children = (self._build(rows[:half]), self._build(rows[half:]))
        s = self.sizes[rows]
        self.nodes.append((self.points[rows].max(0), int(s.min()), int(s.max()), children or (rows,)))
        return len(self.nodes) - 1

    def join(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs i != j (each once) whose bound allows a link, with bound / needed overlap."""
        found = []
        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            up_x, lo_x, hi_x, kids_x = self.nodes[x]
            up_y, lo_y, hi_y, kids_y = self.nodes[y]
            if 100 * hi_x < PERCENT * lo_y or 100 * hi_y < PERCENT * lo_x:
                continue
            if x != y and (100 + PERCENT) * int(np.minimum(up_x, up_y).sum(dtype=np.int64)) < PERCENT * (lo_x + lo_y):
                continue
            leaf_x, leaf_y = len(kids_x) == 1, len(kids_y) == 1
            if leaf_x and leaf_y:
                i, j = kids_x[0], kids_y[0]
                bound = np.minimum(self.points[i][:, None], self.points[j][None]).sum(2, dtype=np.int64)
                need = PERCENT * (self.sizes[i][:, None] + self.sizes[j][None])
                ok = (100 + PERCENT) * bound >= need
                if x == y:
                    ok = np.triu(ok, 1)
                a, b = np.nonzero(ok)
                found.append((i[a], j[b], bound[a, b] * (100 + PERCENT) / need[a, b]))
            elif x == y:
                stack += [(kids_x[0], kids_x[0]), (kids_x[1], kids_x[1]), (kids_x[0], kids_x[1])]
            elif leaf_y or (not leaf_x and hi_x >= hi_y):
                stack += [(k, y) for k in kids_x]
            else:
                stack += [(x, k) for k in kids_y]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))


_PAIR = "a long, b long, likely double"


def _search(batches, best_only: bool):
    """Joins each block with itself: pairs of different components, all of them or each class's best earlier partner.

    With ``best_only``, a block that has more candidates than it gives adds a row (block, null, null).
    """
    lead, told = None, set()
    for t in c.by_key(batches, ["lead", "part", "task", "block"]):
        if t.num_rows < 2:
            continue
        if lead != (now := (t.column("lead")[0].as_py(), t.column("part")[0].as_py())):
            lead, told = now, set()  # pairs that other blocks with the same smallest class have given
        cls, sizes = t.column("cls").to_numpy(), t.column("n").to_numpy()
        cls, one = np.unique(cls, return_index=True)
        component = t.column("component").to_numpy()[one]
        points = _matrix(t.column("counts").take(pa.array(one)).to_pylist())
        i, j, likely = RTree(points, sizes[one]).join()
        a, b = np.minimum(i, j), np.maximum(i, j)
        other = np.flatnonzero(component[a] != component[b])
        a, b, likely = a[other], b[other], likely[other]
        more = []
        if best_only:
            order = np.lexsort((a, -likely, b))
            pick = order[np.flatnonzero(np.diff(b[order], prepend=-1))]
            if len(pick) < len(a):
                more = [t.column("block")[0].as_py()]
        else:
            ends = list(zip(cls[a].tolist(), cls[b].tolist()))
            pick = np.array([k for k, x in enumerate(ends) if x not in told], np.int64)
            if len(told) + len(ends) > TOLD:
                told = set()
            told.update(ends)
        if len(pick):
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[a[pick]].tolist() + more, pa.int64()), pa.array(cls[b[pick]].tolist() + [None] * len(more), pa.int64()),
                 pa.array(likely[pick].tolist() + [None] * len(more), pa.float64())], names=["a", "b", "likely"])


def _tree_pairs(members: DataFrame, best_only: bool) -> DataFrame:
    # A pair that two tasks of one smallest class both give costs work only; TASKS keeps such a class from being one task.
    spread = members.withColumn("task", F.pmod(F.xxhash64("block"), F.lit(TASKS)).cast("int"))
    return spread.repartition("lead", "part", "task").sortWithinPartitions("lead", "part", "task", "block").mapInArrow(
        lambda batches: _search(batches, best_only), _PAIR)


def _texts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and text of the staged classes ``asked`` (cls, at); documents that none of them names stay out of the shuffle."""
    keys = asked.select("cls", F.col("at").alias("key"))
    rows = docs.select(F.xxhash64("text").alias("key"), "text")
    count = keys.count()
    rows = rows.join(F.broadcast(keys), "key") if count <= LISTED else c.marked(rows, keys, count).join(keys, "key")
    return rows.dropDuplicates(["cls"]).select("cls", "text")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """A spanning forest, for each task, of the pairs whose texts satisfy the threshold exactly."""
    needed = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    asked = c.staged(classes.join(needed, "cls", "left_semi").select("cls", "at"), "asked")

    def run(batches):
        links = []
        for batch in c.chunks(batches, "text_a", c.CHUNK // 2):
            x, y = _sets(c.as_bytes(batch.column("text_a"))), _sets(c.as_bytes(batch.column("text_b")))
            shared = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], np.int64)
            total = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64)
            ok = pa.array(100 * shared >= PERCENT * (total - shared))
            links.append((batch.column("a").filter(ok).to_numpy(), batch.column("b").filter(ok).to_numpy()))
        if links:
            a, b = forest(*(np.concatenate(x) for x in zip(*links)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    side = lambda k: texts.select(F.col("cls").alias(k), F.col("text").alias(f"text_{k}"))
    texts = c.staged(_texts(asked, docs), "texts")
    links = c.staged(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long"), "links")
    c.drop_staged(texts, asked)
    return links


def _blocks(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of ordinary blocks (equal blocks once) and of large ones: block, its smallest class, cls (and the members of a large one, m)."""
    heads = classes.select("cls", "n", F.explode("head").alias("h"))
    # Written first: Spark can then split a hot shingle's rows in the join below.
    shared = c.staged(heads.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    rows = c.staged(heads.join(shared, "h"), "block-rows")
    small = rows.where(F.col("m") <= BLOCK).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "cls"))).alias("all"))  # BLOCK values at most
    # Of sets that link, the smaller has PERCENT % of the larger: a class too far from both its neighbours by size links with none here.
    close = lambda a, b: F.coalesce(100 * a["n"] >= PERCENT * b["n"], F.lit(False))
    near = F.filter("all", lambda x, i: close(F.get("all", i - 1), x) | close(x, F.get("all", i + 1)))
    small = small.select("h", F.array_sort(F.transform(near, lambda x: x["cls"])).alias("all")).where(F.size("all") > 1)
    small = small.groupBy("all").agg(F.min("h").alias("block")).select(
        "block", F.element_at("all", 1).alias("lead"), F.explode("all").alias("cls"))
    small = c.staged(small, "blocks")
    large = rows.where(F.col("m") > BLOCK).select(F.col("h").alias("block"), "cls", "m")
    leads = c.staged(large.groupBy("block").agg(F.min("cls").alias("lead")), "leads")
    large = c.staged(large.join(leads, "block"), "large-blocks")
    c.drop_staged(shared, rows, leads)
    return small, large


def _dealt(large: DataFrame, salt: int) -> DataFrame:
    """Each class of ``large`` in one part of one of its blocks, chosen by a hash that copies mostly share."""
    one = large.groupBy("cls").agg(F.min_by(F.struct("block", "lead", "m"), F.struct(F.xxhash64("block", F.lit(salt)), "block")).alias("x"))
    part = F.pmod(F.xxhash64("cls", F.lit(salt)), F.ceil(F.col("x.m") / BLOCK)).cast("int") + 1
    return one.select("x.block", "x.lead", "cls", part.alias("part"))


def _cells(large: DataFrame, of: Components, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of large blocks with several components (cls, component, cell), and the pairs of cells that can hold a link (x, y)."""
    rows = of.now(large.select("block", "cls", "m").join(of.first, "cls"))
    mixed = rows.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("block")
    rows = c.staged(rows.join(mixed, "block"), "mixed-blocks")
    # Linked sets are in one band or in neighbours; a band is a little wider than the ratio, so rounding is no matter.
    band = F.floor(F.log("n") / F.lit(math.log(100 / (PERCENT - 0.5)))).cast("int")
    # Of a class's blocks the largest: classes that share a passage then share cells, and few pairs of cells meet.
    one = rows.groupBy("cls", "component").agg(F.max_by("block", F.struct("m", "block")).alias("block")).join(sizes, "cls").withColumn("band", band)
    # Small components of one block share cells, so that a cell holds classes that meet anyway.
    many = one.groupBy("component").agg(F.count(F.lit(1)).alias("k")).select("component", (F.col("k") > BLOCK).alias("own"))
    one = c.staged(one.join(many, "component").withColumn("of", F.when(F.col("own"), F.col("component")).otherwise(F.col("block"))), "cell-rows")
    group = ["own", "of", "band"]
    parts = one.groupBy(group).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / WEIGHT)).alias("parts"))
    cell = F.xxhash64(*group, F.pmod(F.xxhash64("cls", F.lit(-1)), F.col("parts")))
    members = c.staged(one.join(parts, group).select("cls", "component", *group, cell.alias("cell")), "cells")
    seen = c.staged(rows.select("block", "cls").join(members, "cls").select("block", "cell", *group).distinct(), "cells-of-blocks")
    x = seen.select("block", *[F.col(k).alias(f"{k}_x") for k in ("cell", *group)])
    y = seen.select("block", *[F.col(k).alias(f"{k}_y") for k in ("cell", *group)])
    pairs = x.join(y, "block").where(
        (F.col("cell_x") <= F.col("cell_y")) & (F.abs(F.col("band_x") - F.col("band_y")) <= 1)
        & ~(F.col("own_x") & F.col("own_y") & (F.col("of_x") == F.col("of_y"))))
    return members.select("cls", "component", "cell"), c.staged(pairs.select(F.col("cell_x").alias("x"), F.col("cell_y").alias("y")).distinct(), "cell-pairs")


def _corners(held: DataFrame) -> DataFrame:
    """Upper corner of the count vectors of each cell, and its range of set sizes. A cell holds about BLOCK classes."""

    def run(batches):
        for t in c.by_key(batches, ["cell"]):
            sizes = t.column("n").to_numpy()
            top = _matrix(t.column("counts").to_pylist()).max(axis=0)
            yield pa.RecordBatch.from_pydict({"cell": t.column("cell")[:1].combine_chunks(), "top": pa.array([top.tobytes()], pa.binary()),
                                              "low": pa.array([int(sizes.min())]), "high": pa.array([int(sizes.max())])})

    return held.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, top binary, low long, high long")


def _can_link(pairs: DataFrame, corners: DataFrame) -> DataFrame:
    """Pairs of cells that the bound of the R-tree allows, tested on whole cells before any class is copied to a pair."""
    end = lambda k: corners.select(F.col("cell").alias(k), *[F.col(n).alias(f"{n}_{k}") for n in ("top", "low", "high")])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_matrix(batch.column(f"top_{k}").to_pylist()) for k in "xy")
            low_x, low_y, high_x, high_y = (batch.column(f"{n}_{k}").to_numpy() for n in ("low", "high") for k in "xy")
            ok = (100 + PERCENT) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= PERCENT * (low_x + low_y)
            ok &= (100 * high_x >= PERCENT * low_y) & (100 * high_y >= PERCENT * low_x)
            yield batch.select(["x", "y"]).filter(pa.array(ok))

    return pairs.join(end("x"), "x").join(end("y"), "y").mapInArrow(run, "x long, y long")


def _met(held: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each pair of cells: x, y and the columns of ``held`` (cell, cls, component and others)."""
    rows = pairs.withColumn("cell", F.explode(F.array_distinct(F.array("x", "y")))).join(held, "cell")
    return rows.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(run, schema)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a pair of cells are in its first and in its second cell."""
    cell = t.column("cell").to_numpy()
    return cell == t.column("x")[0].as_py(), cell == t.column("y")[0].as_py()


def _search_cells(batches):
    """Candidates (a, b) of each pair of cells between different components, or (null, null, x, y) where they are many."""
    for t in c.by_key(batches, ["x", "y"]):
        cls, component = t.column("cls").to_numpy(), t.column("component").to_numpy()
        i, j, _ = RTree(_matrix(t.column("counts").to_pylist()), t.column("n").to_numpy()).join()
        first, second = _sides(t)
        ok = (component[i] != component[j]) & ((first[i] & second[j]) | (second[i] & first[j]))
        a, b = np.minimum(cls[i[ok]], cls[j[ok]]), np.maximum(cls[i[ok]], cls[j[ok]])
        if len(a) > DENSE * t.num_rows:
            ends = [pa.nulls(1, pa.int64())] * 2 + [pa.array([t.column(k)[0].as_py()], pa.int64()) for k in ("x", "y")]
        else:
            ends = [pa.array(a), pa.array(b)] + [pa.nulls(len(a), pa.int64())] * 2
        yield pa.RecordBatch.from_arrays(ends, names=["a", "b", "x", "y"])


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``i`` with sets ``j``, over 8,192 shingles at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = held > 1
    row, at = row[some[at]], (np.cumsum(some) - 1)[at[some[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(i), len(j)))
    for low in range(0, int(some.sum()), 8192):
        cut = slice(*np.searchsorted(at, [low, low + 8192]))
        has = np.zeros((len(sets), 8192), np.float32)
        has[row[cut], at[cut] - low] = 1
        out += has[i] @ has[j].T
    return out.astype(np.int64)


def _link_cells(batches):
    """A spanning forest of the links of each pair of cells between different components, from whole sets."""
    for t in c.by_key(batches, ["x", "y"]):
        cls, component = t.column("cls").to_numpy(), t.column("component").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        i, j = (np.flatnonzero(k) for k in _sides(t))
        sizes = np.array([len(s) for s in sets])
        shared = _shared(sets, i, j)
        ok = (100 * shared >= PERCENT * (sizes[i][:, None] + sizes[j][None] - shared)) & (component[i][:, None] != component[j][None])
        p, q = np.nonzero(ok)
        a, b = forest(cls[i[p]], cls[j[q]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _whole_sets(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and its sorted shingle hashes."""

    def run(batches):
        for batch in c.chunks(batches):
            sets = _sets(c.as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "shingles"])

    return _texts(c.staged(classes.select("cls", "at"), "asked"), docs).mapInArrow(run, "cls long, shingles binary")


def _linked_cells(members: DataFrame, dense: DataFrame, of: Components, classes: DataFrame, docs: DataFrame) -> None:
    """Joins components by the links inside the ``dense`` pairs of cells."""
    held = dense.select(F.explode(F.array("x", "y")).alias("cell")).distinct()
    needed = c.staged(of.now(members.join(held, "cell", "left_semi")), "dense-cells")
    now = needed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    end = lambda k: now.select(F.col("cell").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}"))
    open_ = dense.join(end("x"), "x").join(end("y"), "y").where("least(low_x, low_y) < greatest(high_x, high_y)").select("x", "y")
    sets = c.staged(_whole_sets(classes.join(needed, "cls", "left_semi"), docs).join(needed, "cls"), "shingle-sets")
    of.merge(c.staged(_met(sets, open_, _link_cells, "a long, b long"), "links"))
    c.drop_staged(sets, needed)


class Components:
    """Component of every class as it was first found, and a small map of the components that have moved since.

    The table of all classes is never written anew: a merge reads it for the ends of new links only and extends the map.
    """

    def __init__(self, first: DataFrame) -> None:
        self.first = first  # cls, component
        self.moved: DataFrame | None = None  # component, to

    def now(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the present one in place of the first component."""
        if self.moved is None:
            return rows
        names = rows.columns
        return rows.join(self.moved, "component", "left").withColumn("component", F.coalesce("to", "component")).select(names)

    def merge(self, links: DataFrame) -> None:
        """Join the components that ``links`` (a, b) connect."""
        ends = links.select(F.col("a").alias("cls")).unionAll(links.select(F.col("b").alias("cls"))).distinct()
        ends = c.staged(self.now(self.first.join(ends, "cls", "left_semi")), "ends")
        end = lambda k: ends.select(F.col("cls").alias(k), F.col("component").alias(f"of_{k}"))
        across = links.join(end("a"), "a").join(end("b"), "b").select("of_a", "of_b")
        merged = c.staged(components(across, "of_a", "of_b").select(F.col("id").alias("component"), F.col("component").alias("to")).where("component <> to"), "moves")
        if self.moved is not None:
            again = merged.select(F.col("component").alias("to"), F.col("to").alias("further"))
            before = self.moved.join(again, "to", "left").select("component", F.coalesce("further", "to").alias("to"))
            merged, old, more = c.staged(before.unionByName(merged), "moves"), self.moved, merged
            c.drop_staged(old, more)
        c.drop_staged(ends)
        self.moved = merged


def _apart(pairs: DataFrame, of: Components) -> DataFrame:
    """Pairs whose ends are in different components; only their ends are looked up."""
    ends = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    ends = c.staged(of.now(of.first.join(ends, "cls", "left_semi")), "ends")
    end = lambda k: ends.select(F.col("cls").alias(k), F.col("component").alias(f"of_{k}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").where("of_a <> of_b").select("a", "b")


def _best(found: DataFrame) -> DataFrame:
    return found.where("b is not null").groupBy("b").agg(F.max_by("a", F.struct("likely", "a")).alias("a")).select("a", "b")


def _components_of_rows(docs: DataFrame) -> DataFrame:
    """doc_id, at (text hash), n, component_id of every row."""
    c.tuned(docs.sparkSession)
    points = c.staged(_points(docs, common_shingles(docs)), "points")
    classes = points.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("head").alias("head"))
    whole = c.staged(classes, "classes")
    rows = c.staged(points.select("doc_id", "at", "n", "cls"), "rows")
    c.drop_staged(points)
    small, large = _blocks(whole)
    classes = c.staged(whole.drop("head"), "classes")
    c.drop_staged(whole)
    point = classes.select("cls", "n", "counts")
    members = small.withColumn("part", F.lit(0)).unionByName(_dealt(large, 0)).join(point, "cls").withColumn("component", F.col("cls"))
    found = c.staged(_tree_pairs(members, True), "found")
    tried = c.staged(_best(found), "pairs")
    links = _verified(tried, classes, docs)
    known = components(links).withColumnRenamed("id", "cls")
    of = Components(c.staged(classes.select("cls").join(known, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component")), "of"))
    # cls, n, counts, component of the classes in large blocks: one join by class for all rounds.
    placed = c.staged(point.join(large.select("cls").distinct(), "cls", "left_semi").join(of.first, "cls"), "placed")
    for salt in range(1, ROUNDS + 1 if not large.isEmpty() else 1):
        again = of.now(_dealt(large, salt).join(placed, "cls"))
        pairs = c.staged(_best(_tree_pairs(again, True)).join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        of.merge(_verified(pairs, classes, docs))
        tried = tried.unionByName(pairs)
    # Last round: all pairs of different components not yet tried, among them those that the first search gave and _best left out.
    apart = lambda pairs: _apart(pairs, of)
    left = apart(found.where("b is not null").select("a", "b"))
    open_ = found.where("b is null").select(F.col("a").alias("block")).distinct()
    some = c.staged(of.now(small.join(open_, "block", "left_semi").join(of.first, "cls")), "open-blocks")  # blocks hold BLOCK classes at most
    c.drop_staged(small)
    mixed = some.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("block")
    rest = some.join(mixed, "block", "left_semi").withColumn("part", F.lit(0)).join(point, "cls")
    pairs = _tree_pairs(rest, False).select("a", "b").unionByName(left)
    members, cells = _cells(large, of, classes.select("cls", "n"))
    held = c.staged(members.join(placed.select("cls", "n", "counts"), "cls"), "cell-points")
    cells = _can_link(cells, c.staged(_corners(held), "corners"))
    met = c.staged(_met(held, cells, _search_cells, "a long, b long, x long, y long"), "met-cells")
    pairs = pairs.unionByName(met.where("a is not null").select("a", "b")).distinct()
    last = c.staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not last.isEmpty():
        of.merge(_verified(last, classes, docs))
    dense = met.where("a is null").select("x", "y")
    if not dense.isEmpty():
        _linked_cells(members, dense, of, classes, docs)
    final = of.now(of.first)
    low = final.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("low"))
    final = final.join(low, "component").select("cls", "low")
    ids = classes.select("cls", "rep").join(final, "cls", "left").select("cls", F.coalesce("low", "rep").alias("component_id"))
    out = rows.select("doc_id", "at", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(ids, "cls", "left")
    return out.select("doc_id", "at", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _components_of_rows(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns as they were.

    Documents without words stay. Rows repeated with one id and text are one document and stay or go together, and so do
    the rows of a component without any id.
    """
    stays = (F.col("n") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = _components_of_rows(docs).groupBy("doc_id", "at").agg(F.max(stays).alias("stays")).where("not stays")
    gone = c.staged(gone.select(F.col("doc_id").alias("_gone_id"), F.col("at").alias("_gone_at")), "gone")
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_at"), F.struct(*[F.col(f"`{k}`") for k in docs.columns]).alias("_row"))
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_at") == F.col("_gone_at"))
    count = gone.count()
    if count <= LISTED:
        return whole.join(F.broadcast(gone), same, "left_anti").select("_row.*")
    # Documents that the bitmap names are looked up in a shuffle, the others stay out of it.
    keys, whole = gone.select(F.xxhash64("_gone_id", "_gone_at").alias("key")), whole.withColumn("key", F.xxhash64("_id", "_at"))
    named = c.marked(whole, keys, count).join(gone, same, "left_anti")
    return c.marked(whole, keys, count, "left_anti").unionByName(named).select("_row.*")


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_copies(c.table(spark, sf_dir, "documents"))
