"""Suffix dedup by a distributed merge sort that knows common prefixes.

A byte goes if a ``LENGTH``-byte string over it also starts anywhere else in the texts (same document included). Texts are
UTF-8 bytes; matches never cross documents; strings are judged on the input.

1. Suffixes to sort. Anchors are positions whose ``GRAM``-byte hash is least in some run of ``WINDOW`` positions. Every
   LENGTH-byte string holds the anchor of its first WINDOW positions, at a place that depends on the string
   alone, so equal strings have their anchors at equal places. As in prefix-doubling string sorting, anchors whose next ``NEED`` bytes
   are unique (by hash) cannot matter and stay at home.
2. Runs. Tasks sort the remaining suffixes (cut after LENGTH + WINDOW bytes), join equal ones, and write them front-coded:
   common prefix with the predecessor and the rest. Runs are cut into parts by sampled splitters; each piece also
   carries the run's neighbours just outside the part, so neighbours across a cut are known on both sides.
3. Merge. Each part is merged by a loser tree whose losers keep their common prefix with the winner that beat them. Two
   candidates are compared from their common prefix on, or not at all if the prefixes differ. The merged common prefixes
   give, for each suffix, the longest match R with any other.
4. R >= LENGTH covers R bytes from the anchor. What is left are strings that begin before their anchor and are not
   covered: left edges and matches hardly longer than LENGTH. Their anchors' groups are asked for
   those strings in blocks of up to ``BLOCK`` neighbours: a block whose bytes occur twice is covered as a whole, one
   whose middle (the bytes that all its strings share) is unique has no string that occurs twice. Only where
   blocks share their middle and differ at an edge are single strings hashed, once for each distinct block; hashes
   that occur twice cover theirs.

Texts are read where their anchors are needed. Where the list of them is too long to be broadcast, a bitmap of their hashed keys is, so that
other texts stay out of the shuffle.

Equal texts are one text with a count (all bytes go if there are two and they are long enough), so a hot text is sorted once, and equal
suffixes of a run are exchanged once, so a hot passage costs each run one string.

``dedup`` can count in words: every word becomes a code of ``CODE`` characters, the same sort runs over the codes, and a word goes if a string of
LENGTH / CODE words over it also occurs anywhere else. White space stays.

Null, empty and short texts keep all bytes. Null or
repeated ids do no harm: a text is known by its hash. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import common as c

LENGTH = 400
WINDOW = 160
GRAM = 16
NEED = LENGTH - WINDOW + 1  # bytes after an anchor that equal strings share at least
KEEP = LENGTH + WINDOW  # bytes of a suffix that are sorted
RUN_BYTES = 16 << 20
PART_BYTES = 24 << 20
SAMPLE = 20_000  # suffixes that the splitters are taken from
SMALL = 24 << 20  # bytes up to which a table is broadcast
BLOCK = 16  # strings that are compared at once, by neighbouring distances from their anchor
CODE = 8  # characters of a word's code: 48 bits of its hash

_ANCHOR = "key long, fp long, pos int, lo int, hi int"


# ---- anchors

def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = c._powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(c._TABLES[2][data] * up[:len(data)], out=sums[1:])
    return sums, down


def _hashes(sums: np.ndarray, down: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return c.mix((sums[at + size] - sums[at]) * down[at] + np.uint64(size))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, and the least and largest distance of the strings that begin before each and have it as their anchor."""
    n = len(data) - GRAM + 1
    parts = []
    piece = 1 << 18
    for a in range(0, n, piece):  # overlapping pieces, so that long texts need little memory
        sub = data[a:a + piece + WINDOW + GRAM - 2]
        sums, down = _prefix_sums(sub)
        m = len(sub) - GRAM + 1
        if m < WINDOW:
            break
        value = _hashes(sums, down, np.arange(m), GRAM)
        low, width = value, 1
        while width < WINDOW:  # minimum of each run of WINDOW values by doubling
            step = min(width, WINDOW - width)
            low = np.minimum(low[:len(low) - step], low[step:])
            width += step
        # The leftmost position of the minimum: candidates are positions that are the minimum of some run.
        starts = np.arange(len(low))
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        head = np.flatnonzero(new)
        own = np.empty(len(low), np.int64)
        for s, e in zip(head, np.append(head[1:], len(low))):
            hits = s + np.flatnonzero(value[s:e - 1 + WINDOW] == low[s])
            own[s:e] = hits[np.searchsorted(hits, starts[s:e])] if len(hits) > 1 else hits[0]
        parts.append(own + a)
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z
    own = np.concatenate(parts)
    at = np.flatnonzero(np.diff(own, prepend=-1))
    last = np.append(at[1:], len(own)) - 1
    return own[at], own[at] - last, own[at] - at


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in c.chunks(batches):
            keys = batch.column(0).to_numpy()
            out = []
            for key, text in zip(keys, c.as_bytes(batch.column(1))):
                data = np.frombuffer(text, np.uint8)
                pos, lo, hi = anchors(data)
                ok = pos + NEED <= len(data)
                pos, lo, hi = pos[ok], lo[ok], hi[ok]
                if not len(pos):
                    continue
                fp = np.empty(len(pos), np.uint64)
                for a in range(0, len(pos), 4096):
                    mine = pos[a:a + 4096]
                    sums, down = _prefix_sums(data[mine[0]:mine[-1] + NEED])
                    fp[a:a + 4096] = _hashes(sums, down, mine - mine[0], NEED)
                out.append((np.full(len(pos), key), fp.view(np.int64), pos.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "fp", "pos", "lo", "hi"])

    return docs.where(F.octet_length("text") >= LENGTH).select("key", "text").mapInArrow(run, _ANCHOR)


# ---- sorted runs

def _suffix_arrays(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and common prefix of each string with the one before."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    lcp = np.zeros(len(strings), np.int64)
    for a in range(0, len(strings), 4096):
        some = strings[max(0, a - 1):a + 4096]
        grid = np.zeros((len(some), KEEP), np.uint8)
        for i, s in enumerate(some):
            grid[i, :len(s)] = np.frombuffer(s, np.uint8)
        if len(some) > 1:
            differ = grid[1:] != grid[:-1]
            first = np.where(differ.any(1), differ.argmax(1), KEEP)
            at = max(0, a - 1) + 1
            lcp[at:at + len(first)] = np.minimum(np.minimum(first, sizes[at:at + len(first)]), sizes[at - 1:at - 1 + len(first)])
    return sizes, lcp


_RUN = ("part int, run long, idx array<int>, sizes binary, lcps binary, rest binary,"
        " m_idx array<int>, m_key array<long>, m_fp array<long>, m_pos array<int>, m_lo array<int>, m_hi array<int>")


def _runs(texts: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Front-coded sorted runs, cut by the splitters, and (part -1) the places of each run's strings."""
    names = [x.split()[0] for x in _RUN.split(", ")]

    def row(part, run, idx=None, sizes=None, lcps=None, rest=None, members=None):
        cols = [part, run, idx, sizes, lcps, rest, *(members or [None] * 6)]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()),
                 pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cols, kinds)], names=names)

    def write(run, found):
        strings = [x[0] for x in found]
        order = sorted(range(len(strings)), key=strings.__getitem__)
        distinct, number, twice = [], np.zeros(len(order), np.int32), []
        for i in order:
            if not distinct or strings[i] != distinct[-1]:
                distinct.append(strings[i])
                twice.append(0)
            number[i] = len(distinct) - 1
            twice[-1] += 1
        yield row(-1, run, members=[number, *[np.array([x[k] for x in found], np.int64) for k in range(1, 6)]])
        sizes, lcp = _suffix_arrays(distinct)
        cuts = [0]
        for s in splitters:
            cuts.append(_after(distinct, s, cuts[-1]))
        cuts.append(len(distinct))
        many = np.array(twice) > 1
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            x, y = max(0, a - 1), min(len(distinct), b + 1)  # with the neighbours outside
            if y <= x:
                continue
            l, z = lcp[x:y].copy(), sizes[x:y]
            l[0] = 0
            idx = np.arange(x, y, dtype=np.int32)
            idx[many[x:y]] += 1 << 30  # the string occurs more than once in this run
            out = np.where((np.arange(x, y) < a) | (np.arange(x, y) >= b), -1, idx)
            rest = b"".join(distinct[x + i][l[i]:] for i in range(y - x))
            yield row(part, run, out.astype(np.int32), c.pack(z.astype(np.uint16)), c.pack(l.astype(np.uint16)), rest)

    def run(batches):
        task, made, found, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in c.chunks(batches):
            for key, text, places in zip(batch.column(0).to_pylist(), c.as_bytes(batch.column(1)), batch.column(2)):
                v = places.values
                for pos, fp, lo, hi in zip(*(v.field(k).to_pylist() for k in ("pos", "fp", "lo", "hi"))):
                    s = text[pos:pos + KEEP]
                    found.append((s, key, fp, pos, lo, hi))
                    size += len(s)
                    if size >= RUN_BYTES:
                        yield from write((task << 24) | made, found)
                        made, found, size = made + 1, [], 0
        if found:
            yield from write((task << 24) | made, found)

    return texts.select("key", "text", "places").mapInArrow(run, _RUN)


def _after(ordered: list[bytes], s: bytes, lo: int) -> int:
    hi = len(ordered)
    while lo < hi:
        mid = (lo + hi) // 2
        if ordered[mid] <= s:
            lo = mid + 1
        else:
            hi = mid
    return lo


# ---- merge

def _first_difference(a: bytes, b: bytes, at: int) -> int:
    """First place from ``at`` on where two strings differ; the shorter length if none does."""
    n = min(len(a), len(b))
    while at < n:
        to = min(n, at + 64)
        x, y = a[at:to], b[at:to]
        if x != y:
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return to - 1 - (d.bit_length() - 1) // 8
        at = to
    return n


class Run:
    """Reads one front-coded run string by string."""

    def __init__(self, idx, sizes, lcps, rest) -> None:
        self.idx, self.sizes, self.lcps, self.rest = idx, sizes, lcps, rest
        self.i = self.at = 0
        self.string = b""

    def next(self) -> int:
        """Moves to the next string; returns its common prefix with the last one, -1 at the end."""
        if self.i >= len(self.sizes):
            return -1
        lcp = self.lcps[self.i]
        more = self.sizes[self.i] - lcp
        self.string = self.string[:lcp] + self.rest[self.at:self.at + more]
        self.at += more
        self.i += 1
        return lcp


def merge(runs: list[Run]):
    """Merges sorted runs by a loser tree: yields (run number, place in run, common prefix with the string yielded before).

    A node keeps the loser of the match there and the loser's common prefix with the winner. All candidates on a path
    have known common prefixes with the string output last: the longer prefix wins unseen; equal ones
    are compared from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    loser, shared = [-1] * (2 * width), [0] * (2 * width)
    ended = [r.next() < 0 for r in runs] + [True] * (width - len(runs))

    def play(node: int) -> tuple[int, int]:
        """First match of a subtree; all common prefixes start at 0 (with the empty string)."""
        if node >= width:
            return node - width, 0
        (a, la), (b, lb) = play(2 * node), play(2 * node + 1)
        win, lwin, loser[node], shared[node] = match(a, la, b, lb)
        return win, lwin

    def match(a, la, b, lb):
        if ended[b]:
            return a, la, b, 0
        if ended[a]:
            return b, lb, a, 0
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = runs[a].string, runs[b].string
        at = _first_difference(x, y, la)
        if at == len(x) or (at < len(y) and x[at] < y[at]):
            return a, la, b, at
        return b, lb, a, at

    win, lcp = play(1) if width > 1 else (0, 0)
    while not ended[win]:
        yield win, runs[win].i - 1, lcp
        lcp = runs[win].next()
        if lcp < 0:
            ended[win], lcp = True, 0
        node = (win + width) // 2
        while node:
            other = loser[node]
            if other >= 0:
                win, lcp, loser[node], shared[node] = match(win, lcp, other, shared[node])
            node //= 2


def _merge_parts(batches):
    """(run, idx, match): the longest match of each string of a part."""
    for t in c.by_key(batches, ["part"]):
        rows = t.to_pylist()
        runs = [Run(r["idx"], c.unpack(r["sizes"], np.uint16).tolist(), c.unpack(r["lcps"], np.uint16).tolist(), r["rest"]) for r in rows]
        who, place, lcp = [], [], []
        for a, b, l in merge(runs):
            who.append(a), place.append(b), lcp.append(l)
        lcp = np.array(lcp + [0], np.int64)
        best = np.maximum(lcp[:-1], lcp[1:])
        idx = np.array([runs[a].idx[b] for a, b in zip(who, place)], np.int64)
        size = np.array([runs[a].sizes[b] for a, b in zip(who, place)], np.int64)
        best = np.where(idx >= 1 << 30, size, best)
        some = (idx >= 0) & (best >= NEED)
        number = np.array([r["run"] for r in rows], np.int64)[np.array(who, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array((idx[some] & ((1 << 30) - 1)).astype(np.int32)),
                                          pa.array(best[some].astype(np.int32))], names=["run", "idx", "match"])


# ---- cover

def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _settle(batches):
    """For each text: covered intervals (fp null), and groups whose strings before the anchor are still open."""
    for t in c.by_key(batches, ["key"]):
        pos, fp, lo, hi, match = (t.column(k).to_numpy().astype(np.int64) for k in ("pos", "fp", "lo", "hi", "match"))
        full = match >= LENGTH
        start, end = _union(pos[full], pos[full] + match[full])
        low = np.maximum(lo, LENGTH - match)
        some = np.flatnonzero(low <= hi)
        if len(start):
            at = np.searchsorted(start, pos[some] - hi[some], "right") - 1
            inside = (at >= 0) & (end[np.maximum(at, 0)] >= pos[some] - low[some] + LENGTH)
            some = some[~inside]
        n, m = len(start), len(some)
        gap = lambda k: pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n + m, t.column("key")[0].as_py())), pa.concat_arrays([gap(n), pa.array(fp[some])]),
             pa.array(np.concatenate((start, low[some]))), pa.array(np.concatenate((end, hi[some])))], names=["key", "fp", "a", "b"])


def _listed(batches, names: tuple[str, ...]):
    """Keys, texts and numbers of the listed places, up to 1,024 at a time."""
    for batch in c.chunks(batches):
        texts, keys = c.as_bytes(batch.column(1)), batch.column(0).to_numpy()
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        places = batch.column(2).flatten()
        numbers = [places.field(k).to_numpy().astype(np.int64) for k in names]
        for a in range(0, len(of), 1024):
            mine = of[a:a + 1024]
            yield keys[mine], [texts[i] for i in mine], *(x[a:a + 1024] for x in numbers)


def _window_hashes(texts: list[bytes], first: np.ndarray, size: np.ndarray):
    """A function that hashes parts of text[first:first + size]: (number of the text, offset, size) to hash."""
    grid = np.zeros((len(texts), LENGTH + WINDOW), np.uint8)
    for i, (text, a, n) in enumerate(zip(texts, first.tolist(), size.tolist())):
        grid[i, :n] = np.frombuffer(text, np.uint8, n, a)
    up, down = c._powers(LENGTH + WINDOW + 1)
    sums = np.zeros((len(texts), LENGTH + WINDOW + 1), np.uint64)
    np.cumsum(c._TABLES[2][grid] * up[:LENGTH + WINDOW], axis=1, out=sums[:, 1:])
    return lambda i, at, n: c.mix((sums[i, at + n] - sums[i, at]) * down[at] + np.asarray(n).astype(np.uint64))


def _counted(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, ``number[i]`` times: i, and 0, 1, …"""
    i = np.repeat(np.arange(len(number)), number)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(number) - number, number)


def _blocks(batches):
    """Hashes of the middle and of all bytes, first place and number of strings of each block asked for."""
    for keys, texts, pos, a, b in _listed(batches, ("pos", "a", "b")):
        # Distances of the first and the last string.
        far, near = np.minimum(b, pos), np.maximum(a, pos + LENGTH - np.fromiter(map(len, texts), np.int64, len(texts)))
        some = np.flatnonzero(far >= near)
        keys, pos, far, near = keys[some], pos[some], far[some], near[some]
        hashes = _window_hashes([texts[i] for i in some], pos - far, far - near + LENGTH)
        i, block = _counted(far // BLOCK - near // BLOCK + 1)
        block += near[i] // BLOCK
        low = block * BLOCK
        middle = c.mix(hashes(i, far[i] - low, LENGTH - BLOCK + 1) + block.astype(np.uint64))
        low, high = np.maximum(low, near[i]), np.minimum(low + BLOCK - 1, far[i])
        whole = hashes(i, far[i] - high, LENGTH + high - low)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (middle.view(np.int64), whole.view(np.int64), keys[i], (pos[i] - high).astype(np.int32),
                                                                (high - low + 1).astype(np.int32))], names=["middle", "whole", "key", "at", "n"])


def _strings(batches):
    """Hash and place of every string of the blocks asked for."""
    for keys, texts, at, n in _listed(batches, ("at", "n")):
        hashes = _window_hashes(texts, at, n - 1 + LENGTH)
        i, place = _counted(n)
        yield pa.RecordBatch.from_arrays([pa.array(hashes(i, place, LENGTH).view(np.int64)), pa.array(keys[i]), pa.array((at[i] + place).astype(np.int32))],
                                         names=["string", "key", "at"])


_marked = c.marked


def _joined(rows: DataFrame, table: DataFrame, size: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` on ``key`` (inner or left). Beyond SMALL bytes of summed ``size`` both are shuffled, but of the rows only those that ``_marked`` lets pass."""
    count, held = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    if held <= SMALL:
        return rows.join(F.broadcast(table), "key", how)
    out = _marked(rows, table, count).join(table, "key", how)
    return out if how == "inner" else out.unionByName(_marked(rows, table, count, "left_anti"), allowMissingColumns=True)


def _near(table: DataFrame, size: Column) -> DataFrame:
    """Broadcast hint if the summed ``size`` of the rows stays within SMALL bytes; else Spark joins by shuffle."""
    held = table.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(table) if held <= SMALL else table


def covered(docs: DataFrame) -> DataFrame:
    """(key, starts, ends) for each text (by hash ``key``) that loses bytes: maximal covered runs."""
    spark = c.tuned(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).where(F.octet_length("text") >= LENGTH)
    copies = c.staged(texts.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                               F.max(F.octet_length("text")).alias("size")), "copies")
    rows = c.staged(_anchor_rows(texts), "anchors")
    # Small sides are written first: Spark can then split the rows of a hot passage in the joins.
    shared = c.staged(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "shared")
    left = c.staged(rows.join(shared, "fp").select("key", "fp", "pos", "lo", "hi"), "shared-anchors")
    c.drop_staged(rows, shared)
    count = left.count()
    places = left.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("pos", "fp", "lo", "hi"))).alias("places")).join(copies.select("key", "rep"), "key")
    places = c.staged(places, "places")

    def with_text(table: DataFrame, listed: str) -> DataFrame:
        """One row of each text in ``table``; ``listed`` is its array."""
        other = table.withColumnRenamed("rep", "_rep")
        return _joined(texts, other, 64 + 40 * F.size(listed)).where(F.col("doc_id").eqNullSafe(F.col("_rep"))).drop("_rep")

    chosen = with_text(places, "places")
    parts = max(1, -(-count * KEEP // PART_BYTES))
    runs = c.staged(_runs(chosen, _splitters(chosen, parts)), "runs")
    c.drop_staged(places)
    order = ["part", "run"]
    merged = runs.where("part >= 0").select("part", "run", "idx", "sizes", "lcps", "rest").repartition(parts, "part").sortWithinPartitions(
        *order).mapInArrow(_merge_parts, "run long, idx int, match int")
    members = runs.where("part = -1").select("run", F.explode(F.arrays_zip("m_idx", "m_key", "m_fp", "m_pos", "m_lo", "m_hi")).alias("m")).select(
        "run", F.col("m.m_idx").alias("idx"), *[F.col(f"m.m_{k}").alias(k) for k in ("key", "fp", "pos", "lo", "hi")])
    found = members.join(merged, ["run", "idx"]).drop("run", "idx")
    settled = c.staged(found.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_settle, "key long, fp long, a long, b long"), "settled")
    c.drop_staged(runs)
    asks = c.staged(settled.where("fp is not null").groupBy("fp").agg(F.min("a").alias("a"), F.max("b").alias("b")), "asks")
    wanted = left.join(asks, "fp").select("key", "pos", F.greatest("a", "lo").alias("a"), F.least("b", "hi").alias("b")).where("a <= b")
    wanted = wanted.groupBy("key").agg(F.collect_set(F.struct("pos", "a", "b")).alias("asks")).join(copies.select("key", "rep"), "key")
    wanted = c.staged(wanted, "wanted")
    c.drop_staged(left, asks)
    blocks = c.staged(with_text(wanted, "asks").select("key", "text", "asks").mapInArrow(_blocks, "middle long, whole long, key long, at int, n int"), "blocks")
    c.drop_staged(wanted)
    # Blocks of equal bytes stand at equal places of their middle: one of them is compared for all.
    kinds = c.staged(blocks.groupBy("middle", "whole").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("key", "at", "n")).alias("one")), "blocks-kinds")
    again = c.staged(kinds.where("found > 1").select("whole"), "blocks-twice")
    late_blocks = blocks.join(again, "whole").select("key", F.col("at").cast("long").alias("a"), (F.col("at") + F.col("n") - 1 + LENGTH).cast("long").alias("b"))
    open_ = c.staged(kinds.groupBy("middle").agg(F.count(F.lit(1)).alias("kinds"), F.min("found").alias("least")).where("kinds > 1 and least = 1").select("middle"), "blocks-open")
    single = kinds.join(open_, "middle").select("one.*").groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("asks")).join(copies.select("key", "rep"), "key")
    single = c.staged(single, "wanted-strings")
    strings = c.staged(with_text(single, "asks").select("key", "text", "asks").mapInArrow(_strings, "string long, key long, at int"), "strings")
    c.drop_staged(kinds, open_, single)
    twice = c.staged(strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string"), "twice")
    late = strings.join(twice, "string").select("key", F.col("at").cast("long").alias("a"), (F.col("at") + LENGTH).cast("long").alias("b"))
    whole = copies.where("copies > 1").select("key", F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))
    spans = settled.where("fp is null").select("key", "a", "b").unionAll(late_blocks).unionAll(late).unionAll(whole)

    def join_up(batches):
        for t in c.by_key(batches, ["key"]):
            a, b = _union(t.column("a").to_numpy(), t.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([t.column("key").chunk(0)[:1], pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64()))],
                                             names=["key", "starts", "ends"])

    out = spans.repartition("key").sortWithinPartitions("key").mapInArrow(join_up, "key long, starts array<long>, ends array<long>")
    out = c.staged(out, "covered")
    c.drop_staged(copies, settled, blocks, again, strings, twice)
    return out


def _splitters(chosen: DataFrame, parts: int) -> list[bytes]:
    """Quantiles of a bounded sample of the suffixes."""
    if parts < 2:
        return []
    place = F.explode("places")
    some = chosen.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(16)) == 0).limit(SAMPLE // 8).select("text", place.alias("p"))
    cut = F.substring(F.encode("text", "utf-8"), F.col("p.pos") + 1, F.lit(KEEP))
    rows = some.select(cut.alias("s")).limit(SAMPLE).collect()
    strings = sorted({bytes(r["s"]) for r in rows})
    return sorted({strings[len(strings) * k // parts] for k in range(1, parts)}) if len(strings) >= parts else strings


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_starts`` and ``_ends`` of the bytes that go (null: none)."""
    spans = covered(docs).select("key", F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
    return _joined(docs.withColumn("key", F.xxhash64("text")), spans, 48 + 16 * F.size("_starts"), "left").drop("key")


def _rest(text: bytes, starts, ends) -> bytes:
    if starts is None:
        return text
    at, out = 0, []
    for a, b in zip(starts, ends):
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def _codes(texts: list[bytes]) -> list[str]:
    """Each text as the codes of its words."""
    t = c.tokens(texts)
    six = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
    shifts = np.arange(0, 6 * CODE, 6, dtype=np.uint64)
    letters = six[((t.hashes[:, None] >> shifts) & np.uint64(63)).astype(np.int64)]
    return [letters[a:b].tobytes().decode() for a, b in zip(t.first[:-1], t.first[1:])]


def covered_words(docs: DataFrame) -> DataFrame:
    """(at, starts, ends) for each text (by hash ``at``) that loses words: runs of byte positions from a first to a last word."""
    c.tuned(docs.sparkSession)

    def code(batches):
        for batch in c.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_codes(c.as_bytes(batch.column(2))))], names=["doc_id", "at", "text"])

    def places(batches):
        for batch in c.chunks(batches):
            t = c.tokens(c.as_bytes(batch.column(1)), hashed=False)
            out = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                first, base = t.first[i], t.doc_start[i]
                low, high = -(-np.array(a) // CODE), np.array(b) // CODE  # words whose whole code is covered
                low, high = low[high > low], high[high > low]
                out.append(((t.starts[first + low] - base).tolist(), (t.ends[first + high - 1] - base).tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in (0, 1))], names=["at", "starts", "ends"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("at"), "text")
    coded = c.staged(texts.mapInArrow(code, "doc_id long, at long, text string"), "word-codes")
    spans = covered(coded)
    named = coded.select("at", F.xxhash64("text").alias("key")).distinct().join(_near(spans, 48 + 16 * F.size("starts")), "key").drop("key")
    one = texts.join(_near(named.select(F.col("at").alias("_at"), "starts", "ends"), 48 + 16 * F.size("starts")), F.col("at") == F.col("_at"))
    one = one.dropDuplicates(["at"]).select("at", "text", "starts", "ends")
    out = c.staged(one.mapInArrow(places, "at long, starts array<long>, ends array<long>"), "covered-words")
    c.drop_staged(coded)
    return out


def dedup(docs: DataFrame, words: bool = False) -> DataFrame:
    """``docs`` without the covered bytes, or words; characters that a cut leaves in pieces go as well. All other columns stay as they were."""
    names = docs.columns
    rest = [n for n in names if n != "text"]
    spans = covered_words(docs).withColumnRenamed("at", "key") if words else covered(docs)
    spans = spans.select(F.col("key").alias("_key"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
    # The other columns go along as one, so that no name of theirs can clash.
    packed = docs.select(F.xxhash64("text").alias("_at"), "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{n}`") for n in rest]).alias("_row"))
    joined = packed.join(_near(spans, 48 + 16 * F.size("_starts")), F.col("_at") == F.col("_key"), "left").select("text", "_row", "_starts", "_ends")

    def run(batches):
        for batch in c.chunks(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            starts, ends = batch.column("_starts").to_pylist(), batch.column("_ends").to_pylist()
            text = [x if x is None else _rest(x, a, b).decode("utf-8", "ignore") if a else x.decode() for x, a, b in zip(raw, starts, ends)]
            kept = dict(zip(rest, batch.column("_row").flatten()[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if n == "text" else kept[n] for n in names], names=names)

    return joined.mapInArrow(run, docs.schema)


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        for batch in c.chunks(batches):
            raw = c.as_bytes(batch.column("text"))
            starts, ends = batch.column("_starts").to_pylist(), batch.column("_ends").to_pylist()
            gone = [sum(b) - sum(a) if a else 0 for a, b in zip(starts, ends)]
            digest = [hashlib.sha256(_rest(x, a, b)).hexdigest() for x, a, b in zip(raw, starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(gone, pa.int64()),
                 pa.array([len(a or ()) for a in starts], pa.int64()), pa.array(digest, pa.string()),
                 pa.array([len(x) - g for x, g in zip(raw, gone)], pa.int64()), pa.array([g == 0 for g in gone])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "whole"])

    return with_spans(docs).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes long, whole boolean")
