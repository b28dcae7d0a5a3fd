"""Conversation prefix trie: nodes of rebuilt conversations, told by composable fingerprints.

A sequence of turns is fingerprinted by a product in a monoid: a turn with hash ``e`` is the map x -> x * BASE + e of
64-bit words, sequences are products of their turns, and two such products (two hashes a turn) name a sequence.
Products of ranges are composed and divided by exponents, so the fingerprint of every prefix of a rebuilt conversation
comes from the head of its base and a range of its own turns: no rebuilt text is ever made, and rows carry numbers only.

Equality is verified, not assumed. Turns with one pair of hashes must have one role and text, compared as stored; each prefix
group must have one parent group and one last turn, so equal groups are equal sequences by induction. If either fails,
all is done anew with other hashes.

Sums over subtrees need no walk down the trie. Each node is owned by its smallest member; the nodes that a conversation owns
are one chain that ends where the conversation ends. The sum over the subtree of a node is the chain totals of all its
members less what its owner holds above the node: one aggregation by node.

Turns are ordered inside sorted ranges of rows; a conversation that crosses ranges is put together from the products of its pieces, so a
conversation of any length is many tasks. The driver sees one row for each range. Ids that end at a node are
written in sorted pieces by many tasks; the one SHA-256 of a node streams over its pieces.

Rows without conv_id belong to no conversation and are left out. A null turn sorts first; equal turns are ordered by their hashes.
A null role or text counts as empty. Remainders follow SQL (sign of the id). Repeated rows are turns of their own; other columns are ignored; an
empty table gives no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as c

GROUP = 20  # a conversation rebuilds from the head of the first of its group
HEADS = 4  # head lengths are below this
PIECE = 1 << 16  # bytes of ids in one piece
RUN = 4096  # depths of a chain that one window sums
BASE = np.uint64(0xD1342543DE82EF95)
TRIES = 8
NODE = ["depth", "f1", "f2"]

_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_WORD = (1 << 64) - 1


def _power(exponents: np.ndarray) -> np.ndarray:
    """BASE to each exponent, in 64-bit words."""
    out, square, left = np.ones(len(exponents), np.uint64), np.full(1, BASE), exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square, out)
        square, left = square * square, left >> 1
    return out


def _words(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    """conv_id, turn, two hashes and the number of words of every turn."""
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("role", "text"))
    words = F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(2 * seed), role, text).alias("e1"), F.xxhash64(role, text, F.lit(2 * seed + 1)).alias("e2"),
        words.cast("long").alias("words"), role.alias("role"), text.alias("text"))


def _one_text(turns: DataFrame) -> bool:
    """Every pair of hashes names one role and text."""
    stored = F.struct("role", "text")
    return turns.groupBy("e1", "e2").agg(F.min(stored).alias("x"), F.max(stored).alias("y")).where("x != y").isEmpty()


def _ranges(turns: DataFrame) -> DataFrame:
    """Sorted ranges of turns; place and product of each turn inside its range."""

    def scan(batches):
        last, at, h1, h2 = None, 0, np.uint64(0), np.uint64(0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = np.flatnonzero(np.concatenate(([conv[0] != last], conv[1:] != conv[:-1])))
            begin = np.zeros(n, np.int64)
            begin[first] = first
            begin = np.maximum.accumulate(begin)
            step = np.arange(n) - begin + 1
            goes_on = np.zeros(n, bool)
            goes_on[:first[0] if len(first) else n] = True
            up, down = _powers(n + 1)
            outs = []
            for held, name in ((h1, "e1"), (h2, "e2")):
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(_words(batch.column(name)) * down[1:n + 1], out=total[1:])
                own = (total[1:] - total[begin]) * up[1:n + 1]
                outs.append(own + np.where(goes_on, held * up[step], np.uint64(0)))
            place = step + np.where(goes_on, at, 0)
            last, at, h1, h2 = conv[-1], int(place[-1]), outs[0][-1], outs[1][-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("range"), batch.column("conv_id"), pa.array(place), *(pa.array(o.view(np.int64)) for o in outs),
                 *(batch.column(k) for k in ("e1", "e2", "words"))],
                names=["range", "conv_id", "place", "h1", "h2", "e1", "e2", "words"])

    keys = ["conv_id", F.col("turn").asc_nulls_first(), "e1", "e2"]
    slim = turns.select("conv_id", "turn", "e1", "e2", "words")
    dealt = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id())
    names = ", ".join(f"{k} long" for k in ("conv_id", "place", "h1", "h2", "e1", "e2", "words"))
    return c.staged(dealt.mapInArrow(scan, f"range int, {names}"), "turn-ranges")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to 0 ... n-1."""
    out = []
    for base in (BASE, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _prefixes(ranges: DataFrame) -> DataFrame:
    """Place and product of every turn in its conversation: the product of earlier ranges times its own."""
    ends = ranges.groupBy("range").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "h1", "h2")).alias("end"))
    ahead: dict[int, tuple[int, int, int, int]] = {}
    conv, n, h1, h2 = None, 0, 0, 0
    for r in sorted(ends.collect(), key=lambda r: r["range"]):  # one row a range
        e = r["end"]
        if r["first"] == conv:
            ahead[r["range"]] = (conv, n, h1, h2)
        goes_on = r["first"] == conv and e["conv_id"] == conv
        up = pow(int(BASE), e["place"], 1 << 64)
        conv, n = e["conv_id"], e["place"] + (n if goes_on else 0)
        h1, h2 = ((e[k] + (h * up if goes_on else 0)) & _WORD for k, h in (("h1", h1), ("h2", h2)))

    def shift(batches):
        for batch in batches:
            place, conv = batch.column("place").to_numpy(), batch.column("conv_id").to_numpy()
            h = [_words(batch.column(k)) for k in ("h1", "h2")]
            for r in np.unique(batch.column("range").to_numpy()):
                if int(r) in ahead:
                    whose, n, *held = ahead[int(r)]
                    mine = (batch.column("range").to_numpy() == r) & (conv == whose)
                    up = _power(place)
                    h = [np.where(mine, x + np.uint64(y & _WORD) * up, x) for x, y in zip(h, held)]
                    place = np.where(mine, place + n, place)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(place), *(pa.array(x.view(np.int64)) for x in h), *(batch.column(k) for k in ("e1", "e2", "words"))],
                names=["conv_id", "place", "h1", "h2", "e1", "e2", "words"])

    names = ", ".join(f"{k} long" for k in ("conv_id", "place", "h1", "h2", "e1", "e2", "words"))
    return c.staged(ranges.mapInArrow(shift, names), "turn-prefixes")


def _frames(turns: DataFrame) -> DataFrame:
    """For each conversation: head length, base head, product of its own head, rebuilt length."""
    turn = F.struct("h1", "h2", "e1", "e2", "words")
    heads = [F.max(F.when(F.col("place") == k, turn)).alias(f"t{k}") for k in range(1, HEADS)]
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n"), *heads)
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[F.col(f"t{k}").alias(f"b{k}") for k in range(1, HEADS)])
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn(
        "cut", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    head = F.least("cut", F.coalesce("base_n", F.lit(0)))
    joined = own.join(base, "base", "left").withColumn("head", head)

    def at(names: str, index: Column, field: str) -> Column:
        return F.coalesce(*[F.when(index == k, F.col(f"{names}{k}.{field}")) for k in range(1, HEADS)], F.lit(0)).cast("long")

    return joined.select(
        "conv_id", "cut", "head", (F.col("head") + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).alias("size"),
        *[at("b", F.col("head"), k).alias(f"b_{k}") for k in ("h1", "h2")], *[at("t", F.col("cut"), k).alias(f"o_{k}") for k in ("h1", "h2")],
        F.array(*[f"b{k}" for k in range(1, HEADS)]).alias("turns"))


_MEMBER = ["conv_id", "depth", "f1", "f2", "p1", "p2", "e1", "e2", "words", "left"]


def _members(turns: DataFrame, frames: DataFrame) -> DataFrame:
    """A row for each conversation and each prefix of its rebuilt turns: product, product without the last turn, turns left."""
    zero = F.lit(0).cast("long")
    roots = frames.select("conv_id", *[zero.alias(k) for k in _MEMBER[1:9]], F.col("size").alias("left"))
    heads = frames.where("head > 0").select("conv_id", "size", "turns", F.explode(F.sequence(F.lit(1), F.col("head").cast("int"))).alias("depth"))
    t, above = F.col("turns")[F.col("depth") - 1], F.when(F.col("depth") > 1, F.get("turns", F.col("depth") - 2))
    heads = heads.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), t["h1"].alias("f1"), t["h2"].alias("f2"),
        F.coalesce(above["h1"], zero).alias("p1"), F.coalesce(above["h2"], zero).alias("p2"), t["e1"].alias("e1"), t["e2"].alias("e2"),
        t["words"].alias("words"), (F.col("size") - F.col("depth")).alias("left"))
    own = turns.join(frames.drop("turns"), "conv_id").where("place > cut")

    def compose(batches):
        for batch in batches:
            col = lambda k: batch.column(k).to_numpy()
            steps = col("place") - col("cut")
            up, depth = _power(steps), col("head") + steps
            outs = []
            for k in ("1", "2"):
                base, own, whole = (_words(batch.column(x + k)) for x in ("b_h", "o_h", "h"))
                outs.append(base * up + (whole - own * up))
            above = [(f - _words(batch.column(e))) * _INVERSE for f, e in zip(outs, ("e1", "e2"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(depth), *(pa.array(x.view(np.int64)) for x in (*outs, *above)),
                 *(batch.column(k) for k in ("e1", "e2", "words")), pa.array(col("size") - depth)], names=_MEMBER)

    own = own.mapInArrow(compose, ", ".join(f"{k} long" for k in _MEMBER))
    return c.staged(roots.unionByName(heads).unionByName(own), "prefix-members")


def _nodes(members: DataFrame) -> DataFrame:
    """One row for each prefix group: owner (smallest member), members, and the bounds of parent and last turn."""
    same = [f(k).alias(f"{name}_{k}") for k in ("p1", "p2", "e1", "e2") for name, f in (("lo", F.min), ("hi", F.max))]
    nodes = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("left").alias("left"), *same)
    return c.staged(nodes, "prefix-nodes")


def _one_sequence(nodes: DataFrame) -> bool:
    """Every group has one parent group and one last turn."""
    differ = [F.col(f"lo_{k}") != F.col(f"hi_{k}") for k in ("p1", "p2", "e1", "e2")]
    return nodes.where(differ[0] | differ[1] | differ[2] | differ[3]).isEmpty()


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, in numerical order."""
    limit = PIECE

    def pieces(batches):
        held, first, ids, size = None, 0, [], 0

        def flush():
            return pa.RecordBatch.from_pydict(dict(zip([*NODE, "first", "ids"], [[x] for x in (*held, first, ",".join(ids))])), schema)

        for batch in batches:
            for *node, conv in zip(*(batch.column(k).to_pylist() for k in (*NODE, "conv_id"))):
                if ids and (node != held or size > limit):
                    yield flush()
                    ids = []
                if not ids:
                    held, first, size = node, conv, 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield flush()

    def digest(batches):
        held, sha = None, None
        schema = pa.schema([(k, pa.int64()) for k in NODE] + [("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids"))):
                if node == held:
                    sha.update(b",")
                else:
                    if held is not None:
                        done.append((*held, sha.hexdigest()))
                    held, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield c.table_of(schema, *zip(*done))
        if held is not None:
            yield c.table_of(schema, *([x] for x in (*held, sha.hexdigest())))

    schema = pa.schema([(k, pa.int64()) for k in (*NODE, "first")] + [("ids", pa.string())])
    key = [*NODE, "conv_id"]
    ends = members.where("left = 0").select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    parts = ends.mapInArrow(pieces, "depth long, f1 long, f2 long, first long, ids string")
    dealt = parts.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(digest, "depth long, f1 long, f2 long, ends_sha256 string")


def _above(nodes: DataFrame) -> DataFrame:
    """What the owner of each node holds above it, summed in runs of depths so that a long chain is many tasks."""
    cut = nodes.select("owner", "depth", "saved", F.floor(F.col("depth") / RUN).alias("run"))
    earlier = Window.partitionBy("owner").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut.groupBy("owner", "run").agg(F.sum("saved").alias("sum")).select("owner", "run", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("owner", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    held = cut.withColumn("in_run", F.coalesce(F.sum("saved").over(inside), F.lit(0)))
    return held.join(runs, ["owner", "run"]).select("owner", "depth", (F.col("ahead") + F.col("in_run")).alias("above"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    c.tuned(conversations.sparkSession)
    for seed in range(TRIES):
        turns = _turns(conversations, seed)
        ranges = _ranges(turns)
        prefixes = _prefixes(ranges)
        members = _members(prefixes, _frames(prefixes))
        nodes = _nodes(members)
        c.drop_staged(ranges, prefixes)
        if _one_sequence(nodes) and _one_text(turns):
            break
        c.drop_staged(members, nodes)
    else:
        raise ValueError(f"hashes of {TRIES} seeds met different turns")

    nodes = nodes.select(
        *NODE, "owner", "n_convs", F.col("lo_p1").alias("p1"), F.col("lo_p2").alias("p2"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("left") == 0).cast("long").alias("leaf"))
    chains = nodes.groupBy("owner").agg(
        F.sum("saved").alias("chain_saved"), F.sum("leaf").alias("chain_leaves"), F.max("depth").alias("low"), F.min(F.struct("depth", "p1", "p2")).alias("top"))
    above = F.col("top.depth") - 1
    heads = chains.where("top.depth > 0").select("owner", above.alias("depth"), F.col("top.p1").alias("f1"), F.col("top.p2").alias("f2"))
    parents = heads.join(nodes.select(*NODE, F.col("owner").alias("parent")), NODE).select("owner", "parent")
    chains = c.staged(chains.join(parents, "owner", "left").select(
        "owner", "chain_saved", "chain_leaves", "low", F.col("top.depth").alias("high"), "top", "parent"), "prefix-chains")

    totals = members.select("conv_id", *NODE).join(
        chains.select(F.col("owner").alias("conv_id"), "chain_saved", "chain_leaves"), "conv_id").select(
        *NODE, "chain_saved", "chain_leaves", F.lit(0).cast("long").alias("hangs"))
    hung = chains.where("high > 0").select(
        (F.col("high") - 1).alias("depth"), F.col("top.p1").alias("f1"), F.col("top.p2").alias("f2"), *[F.lit(0).cast("long").alias(k) for k in ("chain_saved", "chain_leaves")],
        F.lit(1).cast("long").alias("hangs"))
    sums = totals.unionByName(hung).groupBy(*NODE).agg(*[F.sum(k).alias(k) for k in ("chain_saved", "chain_leaves", "hangs")])
    placed = nodes.join(_above(nodes), ["owner", "depth"]).join(chains.select("owner", "low", "high", "parent"), "owner")
    out = placed.join(sums, NODE).join(_ends(members), NODE, "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") > F.col("high"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        (F.col("hangs") + (F.col("depth") < F.col("low")).cast("long")).alias("n_children"), F.col("chain_leaves").alias("n_leaves"),
        (F.col("chain_saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(c.table(spark, sf_dir, "conversations"))
