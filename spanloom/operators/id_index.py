"""Index of stored event ids, so that a batch looks its ids up without reading the history.

Ids are cut into ``BUCKETS`` by hash; each commit adds one folder a bucket, and for each bucket Bloom filters over at most about
``SLICE`` ids. A batch tests its ids against the filters of their buckets and opens only the bucket folders whose filter says
yes. When ``FOLD`` batches have added folders they are written as one, so the number of folders and filters stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 32
SLICE = 1 << 20
BITS = 20  # bits an id: about one false positive in 10,000
PROBES = 8
FOLD = 16


def bucket(event_id: str | Column = "event_id") -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(BUCKETS)).cast("int")


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(1), "event_id").alias("h1"), F.xxhash64(F.lit(2), "event_id").alias("h2")]


def _spots(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(PROBES)]).astype(np.int64)


def filters(ids: DataFrame, name: str, rows: int) -> DataFrame:
    """Filters of the given ids: (name, bucket, slices, slice, bits)."""
    slices = 1
    while slices * SLICE * BUCKETS < rows:
        slices *= 2

    def build(t: pa.Table) -> pa.Table:
        size = max(64, t.num_rows * BITS)
        bits = np.zeros(size, bool)
        bits[_spots(t.column("h1").to_numpy(), t.column("h2").to_numpy(), size).ravel()] = True
        return pa.table({"bucket": t.column("bucket")[:1], "slice": t.column("slice")[:1], "size": pa.array([size]), "bits": pa.array([np.packbits(bits).tobytes()])})

    rows_of = ids.select(bucket().alias("bucket"), *_hashes()).withColumn("slice", F.pmod("h2", F.lit(slices)).cast("int"))
    made = rows_of.groupBy("bucket", "slice").applyInArrow(build, "bucket int, slice int, size long, bits binary")
    return made.select(F.lit(name).alias("name"), "bucket", F.lit(slices).alias("slices"), "slice", "size", "bits")


def hits(ids: DataFrame, stored: DataFrame, slices: list[int]) -> DataFrame:
    """(name, bucket) whose filter may hold one of the ids. ``slices``: the numbers of slices in use, powers of two."""

    def probe(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = []
        if left.num_rows:
            h1, h2 = left.column("h1").to_numpy(), left.column("h2").to_numpy()
            for name, size, bits in zip(*(right.column(k).to_pylist() for k in ("name", "size", "bits"))):
                held = np.unpackbits(np.frombuffer(bits, np.uint8))
                if held[_spots(h1, h2, size)].all(axis=0).any():
                    names.append(name)
        return pa.table({"name": pa.array(names, pa.string()), "bucket": pa.array([key[0].as_py()] * len(names), pa.int32())})

    asked = ids.select(bucket().alias("bucket"), *_hashes(), F.explode(F.array(*[F.lit(s) for s in slices])).alias("slices"))
    asked = asked.withColumn("slice", F.pmod("h2", F.col("slices")).cast("int"))
    on = ["bucket", "slices", "slice"]
    return asked.groupBy(*on).cogroup(stored.groupBy(*on)).applyInArrow(probe, "name string, bucket int").distinct()
