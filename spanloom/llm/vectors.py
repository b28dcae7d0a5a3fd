"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosines.

Vectors are normalised; ``HASHES`` random projections, each shifted and cut into steps of ``WIDTH``, name a bucket in
each of ``TABLES`` tables. For two unit vectors with cosine c the distance is sqrt(2 - 2c), and a bucket number agrees
with the probability of the p-stable scheme; with the values here a pair at cosine 0.93 meets in some table with probability
above 0.99, closer pairs more often. Pairs that share a bucket are compared by cosine in double precision.

Equal vectors of a label are first joined to one class with a count, so exact copies are never compared.
A bucket is cut into blocks of at most ``BLOCK`` classes and pairs of blocks are compared, so a hot bucket is many tasks;
a pair that meets in several tables counts in the first one only. Tasks return, for each class and block pair,
the number of partners and the links of a spanning forest: rows grow with classes, not with pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows whose label is null, link with
nothing, and vectors of different lengths never link. Rows with equal ids are vectors of their own; a null id gets a null component and keeps no row from linking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c
from .components import components, forest

COSINE = 0.93
TABLES = 24
HASHES = 10
WIDTH = 2.0
BLOCK = 1024
SEED = 11


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows with a class number, and one row for each class with its vector and number of rows.

    A class is a label with one vector, known by the smallest row number in it.
    """
    dims = F.col("embedding")
    usable = F.col("label").isNotNull() & (F.size(dims) > 0) & ~F.exists(
        dims, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(dims, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          dims.cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", "label", F.when(usable, F.col("embedding")).alias("embedding"))
    # -0.0 and 0.0 are one value; the key is a 128-bit hash of the components.
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))
    rows = c.staged(rows.withColumn("h1", F.xxhash64("label", plain)).withColumn("h2", F.xxhash64(F.lit(1), plain, "label")), "vectors")
    classes = rows.where("embedding is not null").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    return rows, c.staged(classes.withColumn("cls", F.xxhash64("label", "h1", "h2")), "vector-classes")


def _hashed(classes: DataFrame, dim: int) -> DataFrame:
    """A row for each class and table: bucket, unit vector, its buckets in all tables."""
    rng = np.random.default_rng(SEED)
    lines = rng.normal(size=(dim, TABLES * HASHES))
    shift = rng.uniform(0, WIDTH, TABLES * HASHES)
    odd = rng.integers(0, 1 << 64, (TABLES, HASHES), np.uint64) | np.uint64(1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("embedding"))
            scale = np.abs(unit).max(axis=1, keepdims=True)
            unit = unit / scale
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            steps = np.floor((unit @ lines + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, TABLES, HASHES)
            keys = c.mix((steps * odd[None]).sum(axis=2, dtype=np.uint64))
            n = len(unit)
            take = pa.array(np.repeat(np.arange(n), TABLES))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), dim).cast(pa.list_(pa.float64()))
            every = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), TABLES).cast(pa.list_(pa.int64()))
            for k in range(TABLES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(np.full(n, k, np.int32)), pa.array(keys[:, k].view(np.int64)),
                     batch.column("cls"), batch.column("n"), rows, every],
                    names=["label", "tab", "bucket", "cls", "n", "unit", "keys"])

    return classes.mapInArrow(run, "label long, tab int, bucket long, cls long, n long, unit array<double>, keys array<long>")


def _compare(least: float):
    """Compares the rows of each block pair: partner counts and a spanning forest of its links."""

    def pairs(tab, cls, n, side, unit, keys):
        left = side < 2  # 0: in both blocks, 1: in the first, 2: in the second
        right = side != 1
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        partners = np.zeros(len(cls), np.int64)
        links = []
        for at in range(0, len(i), 256):
            part = i[at:at + 256]
            hit = unit[part] @ unit[j].T >= least
            hit &= (cls[part][:, None] < cls[j][None, :]) if not side.any() else True
            x, y = np.nonzero(hit)
            x, y = part[x], j[y]
            if tab:  # pairs that met in an earlier table count there
                new = ~(keys[x][:, :tab] == keys[y][:, :tab]).any(axis=1)
                x, y = x[new], y[new]
            partners += np.bincount(x, n[y], len(cls)).astype(np.int64) + np.bincount(y, n[x], len(cls)).astype(np.int64)
            links.append(forest(cls[x], cls[y]))
        a, b = forest(np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links]))
        some = partners > 0
        return cls[some], partners[some], a, b

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        col = lambda k: t.column(k).to_numpy()
        flat = lambda k: _matrix(t.column(k).chunk(0))
        keys = np.asarray(t.column("keys").chunk(0).flatten()).reshape(t.num_rows, -1)
        cls, n, a, b = pairs(int(col("tab")[0]), col("cls"), col("n"), col("side"), flat("unit"), keys)
        zero = lambda k: np.zeros(k, np.int64)
        return pa.table({"cls": np.concatenate((cls, a)), "partners": np.concatenate((n, zero(len(a)))),
                         "other": pa.array(np.concatenate((zero(len(cls)), b)), mask=np.arange(len(cls) + len(a)) < len(cls))})

    return run


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    c.tuned(vectors.sparkSession)
    rows, classes = _classes(vectors)
    found = None
    for r in classes.select(F.size("embedding").alias("dim")).distinct().collect():  # lengths, not vectors
        part = _links(classes.where(F.size("embedding") == r["dim"]), r["dim"], least)
        found = part if found is None else found.unionAll(part)
    id_of = classes.select("cls", "label", "h1", "h2", "n", "rep")
    if found is None:
        id_of = id_of.withColumns({"partners": F.lit(0).cast("long"), "component": F.col("rep")})
    else:
        partners = found.where("other is null").groupBy("cls").agg(F.sum("partners").alias("partners"))
        ends = found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))
        names = classes.select("cls", "rep")
        groups = components(ends).withColumnRenamed("id", "cls")
        named = groups.join(names, "cls").groupBy("component").agg(F.min("rep").alias("low"))
        groups = groups.join(named, "component").select("cls", F.col("low").alias("component"))
        id_of = id_of.join(partners, "cls", "left").join(groups, "cls", "left").withColumns({
            "partners": F.coalesce("partners", F.lit(0)), "component": F.coalesce("component", "rep")})
    out = rows.select("vec_id", "label", "h1", "h2", "embedding").join(
        id_of.select("label", "h1", "h2", "n", "partners", "component"), ["label", "h1", "h2"], "left")
    linked = F.col("embedding").isNotNull()
    component = F.when(linked & F.col("vec_id").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.when(linked, F.col("n") - 1 + F.col("partners")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _links(classes: DataFrame, dim: int, least: float) -> DataFrame:
    hashed = _hashed(classes, dim)
    where = ["label", "tab", "bucket"]
    slim = classes.select("label", "cls", "n", "embedding")
    sizes = c.staged(_hashed(slim, dim).select(*where).groupBy(where).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    # Blocks of a bucket: the class hash modulo their number; each block meets itself and every later one.
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = hashed.join(sizes.select(*where, blocks.alias("k")), where).withColumn("own", F.pmod(F.xxhash64("cls", "tab"), F.col("k")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(
        F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    met = met.withColumn("pair", F.explode(pair)).withColumn(
        "side", F.when(F.col("pair.x") == F.col("pair.y"), 0).when(F.col("own") == F.col("pair.x"), 1).otherwise(2).cast("int"))
    group = [*where, F.col("pair.x"), F.col("pair.y")]
    return c.staged(met.groupBy(*group).applyInArrow(_compare(least), "cls long, partners long, other long"), "vector-links")


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "embeddings"))
