"""Sharding: k-d tree partitioning of documents into shards of nearly equal bytes.

Units are groups of equal texts; a group larger than ``1 / UNITS`` of a shard's bytes is cut into
slices by document id, so a hot text cannot unbalance a shard. A unit has metadata dimensions (length,
language, source, text hash). Starting with one node, every node is split along its widest dimension at the
byte-weighted median, until leaves have reached the target of total bytes / shards; with 16 shards these are four levels.
A dimension's width is the spread (weighted standard deviation) of its coordinate, scaled by the whole table's range.
Units are ordered by (coordinate, hash), so ties at the median are split by hash and the cut is exact to about one unit.

The median is found by radix descent: three rounds of counting bytes by ``2**BITS`` buckets of the order key in each node;
the driver only gets one row for each node. Everything is DataFrame functions; no step needs the rows
of a shard together, and slots are numbered by blocks.

Null text has size 1 (no bytes plus one), crc 0 and forms one group; null language, source or id
are a value like others. Repeated rows get slots of their own. Fewer rows than shards leave shards
empty. An empty table gives no rows.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame, Window, functions as F

from . import common as c

SHARDS = 16
UNITS = 256  # a unit has at most 1/UNITS of a shard's bytes, unless one document is larger
BITS = 14
ROUNDS = 3  # a key has BITS * ROUNDS bits: BITS of coordinate, the rest of hash
DIMENSIONS = ("size", "lang", "source", "text")


def _units(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their unit, and one row for each unit with bytes and coordinates in 0 … 2**BITS - 1."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.crc32(text)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_h"),
        F.xxhash64("lang").alias("_lang"), F.xxhash64("source").alias("_source"))
    rows = c.staged(rows, "shard-rows")
    total = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    most = max(1, total // (shards * UNITS))
    groups = rows.groupBy("_h", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    large = groups.where(F.col("size") * F.col("_n") > most).withColumn(
        "_slices", F.ceil(F.col("size") * F.col("_n") / F.lit(most)).cast("long")).select("_h", "size", "text_crc32", "_slices")
    rows = rows.join(large, ["_h", "size", "text_crc32"], "left").withColumn(
        "_slice", F.when(F.col("_slices").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("_slices")))).drop("_slices")
    keys = ["_h", "size", "text_crc32", "_slice"]
    units = rows.groupBy(keys).agg(F.sum("size").alias("bytes"), F.min("_lang").alias("_lang"), F.min("_source").alias("_source"))
    top = float(2 ** BITS - 1)
    share = lambda h: (F.shiftrightunsigned(h, 64 - BITS)).cast("long")
    units = units.select(
        *keys, "bytes",
        F.least(F.floor(F.log2(F.col("size") + 1) / 40 * top), F.lit(top)).cast("long").alias("size_at"),
        share(F.col("_lang")).alias("lang_at"), share(F.col("_source")).alias("source_at"), share(F.col("_h")).alias("text_at"),
        F.shiftrightunsigned(F.xxhash64("_h", "size", "_slice"), 64 - BITS * (ROUNDS - 1)).alias("_tie"))
    return rows, units


def _spread(name: str):
    at = F.col(f"{name}_at").cast("double")
    w = F.col("bytes").cast("double")
    mean = F.sum(at * w) / F.sum(w)
    return F.sqrt(F.greatest(F.sum(at * at * w) / F.sum(w) - mean * mean, F.lit(0.0)))


def _widest(units: DataFrame) -> dict[int, tuple[str, float]]:
    """For each node: its widest dimension and its bytes."""
    ranges = units.agg(*[F.max(f"{d}_at") - F.min(f"{d}_at") for d in DIMENSIONS]).first()
    rows = units.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[_spread(d).alias(d) for d in DIMENSIONS]).collect()
    out = {}
    for r in rows:  # one for each node, at most as many as shards
        width = {d: (r[d] / x if x else 0.0) for d, x in zip(DIMENSIONS, ranges)}
        out[r["node"]] = (max(DIMENSIONS, key=lambda d: (width[d], -DIMENSIONS.index(d))), float(r["bytes"]))
    return out


def _of_node(values: dict, size: int, default, kind: str):
    """The value of a row's node, out of one literal for each node."""
    return F.array(*[F.lit(values.get(n, default)).cast(kind) for n in range(size)])[F.col("node")]


def _medians(units: DataFrame, bytes_of: dict[int, float], nodes: int) -> dict[int, int]:
    """Order key at which the bytes of lower keys of a node come nearest to half."""
    key, below = {n: 0 for n in bytes_of}, {n: 0.0 for n in bytes_of}  # key so far, bytes below it
    for k in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - k)
        at = F.shiftright("key", shift)
        part = units.where(F.shiftright(at, BITS) == _of_node(key, nodes, -1, "long")).groupBy("node", at.alias("at")).agg(
            F.sum("bytes").alias("b"))
        upto = Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        half = _of_node({n: b / 2 - below[n] for n, b in bytes_of.items()}, nodes, 0.0, "double")
        hit = part.withColumn("upto", F.sum("b").over(upto)).where(F.col("upto") >= half).groupBy("node").agg(
            F.min_by(F.struct("at", "upto", "b"), "at").alias("x"))
        for r in hit.collect():  # one for each node
            n = r["node"]
            key[n] = r["x"]["at"]
            below[n] += r["x"]["upto"] - r["x"]["b"]
            if k == ROUNDS - 1 and bytes_of[n] / 2 - below[n] > r["x"]["b"] / 2:
                key[n] += 1  # nearer to half with this key on the left
    return key


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; ``shards`` is a power of two."""
    levels = int(log2(shards))
    if 2 ** levels != shards:
        raise ValueError("the number of shards must be a power of two")
    rows, units = _units(docs, shards)
    units = c.staged(units, "shard-units")
    tree: list[dict[int, tuple[str, int]]] = []
    for level in range(levels):
        at = _place(units, tree)
        widest = _widest(at)
        if not widest:
            break
        keyed = at.select("node", "bytes", _key({n: d for n, (d, _) in widest.items()}, 2 ** level).alias("key"))
        cuts = _medians(c.staged(keyed, "shard-keys"), {n: b for n, (_, b) in widest.items()}, 2 ** level)
        tree.append({n: (widest[n][0], cuts[n]) for n in widest})
    keys = ["_h", "size", "text_crc32", "_slice"]
    where = _place(units, tree).select(*keys, F.col("node").cast("int").alias("shard"))
    out = rows.join(where, keys)
    blocks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = c.gapless(out, ["shard"], ["doc_id", "_h"], "slot", blocks)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _key(dimension: dict[int, str], nodes: int):
    """Order key along the dimension that is split in the row's node."""
    which = {n: DIMENSIONS.index(d) for n, d in dimension.items()}
    coordinate = F.array(*[F.col(f"{d}_at") for d in DIMENSIONS])[_of_node(which, nodes, 0, "int")]
    return F.shiftleft(coordinate, BITS * (ROUNDS - 1)).bitwiseOR(F.col("_tie"))


def _place(units: DataFrame, tree: list[dict[int, tuple[str, int]]]) -> DataFrame:
    """Units with their node below the levels of the tree."""
    out = units.withColumn("node", F.lit(0))
    for level, splits in enumerate(tree):
        key = _key({n: d for n, (d, _) in splits.items()}, 2 ** level)
        right = (key >= _of_node({n: cut for n, (_, cut) in splits.items()}, 2 ** level, 0, "long")).cast("int")
        out = out.withColumn("node", F.col("node") * 2 + right)
    return out


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(c.table(spark, sf_dir, "documents"))
