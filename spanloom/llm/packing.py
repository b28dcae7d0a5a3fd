"""Packing: optimal length buckets and token-budget batches.

Lengths are counted into one global histogram. Dynamic programming over it chooses at most ``BUCKETS``
boundaries so that padding every text to its bucket's boundary wastes least. Inside a bucket, texts are numbered
without gaps, and each run of ``budget // boundary`` texts (at least one) is a batch, so a batch padded to
its boundary stays inside the token budget unless a single text is longer.

The histogram has one count for each length that occurs, and the boundaries are optimal over it: costs of two neighbouring runs meet the quadrangle inequality, so
each layer is the lower envelope of lines and takes linear time. D different lengths need D * D / 2 words, so the driver gets at most the square root
of twice the words: some millions of counts for 100 TB. Length is the number of words; null or empty texts have length 0 and get a
bucket like all others. Rows are numbered in order of (hash, id, text hash); repeated rows get slots of
their own. An empty table gives no rows.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import common as c

BUCKETS = 16
BUDGET = 32_768


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` runs of lengths with least sum of count * bound; ``lengths`` rise.

    With the texts given, least padded volume is least padding. Among equal costs the one with fewer buckets wins. Whole numbers throughout.
    """
    n = len(counts)
    if n == 0:
        return []
    size = [int(x) for x in lengths]
    ahead = [0]
    for x in counts:
        ahead.append(ahead[-1] + int(x))
    best: list[int | None] = [0] + [None] * n
    choice, answers = [], []
    for _ in range(min(buckets, n)):
        # now[j] = min over i < j of best[i] + (ahead[j] - ahead[i]) * size[j - 1]: lines in i, asked at rising sizes.
        now: list[int | None] = [None] * (n + 1)
        back, hull, at = array("q", bytes(8 * (n + 1))), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                while len(hull) - at >= 2:
                    p, q = hull[-2], hull[-1]
                    if (best[i] - best[p]) * (ahead[q] - ahead[p]) <= (best[q] - best[p]) * (ahead[i] - ahead[p]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            if len(hull) == at:
                continue
            x = size[j - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - ahead[hull[at + 1]] * x < best[hull[at]] - ahead[hull[at]] * x:
                at += 1
            back[j] = hull[at]
            now[j] = best[hull[at]] + (ahead[j] - ahead[hull[at]]) * x
        choice.append(back)
        answers.append(now[n])
        best = now
    k = min((a, k) for k, a in enumerate(answers) if a is not None)[1]
    cuts, at = [], n
    while k >= 0:
        cuts.append(size[at - 1])
        at = choice[k][at]
        k -= 1
    return cuts[::-1]


def plan(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for a frame with a ``length`` column."""
    rows = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").toArrow()  # one row a length, see above
    return boundaries(rows.column("length").to_numpy(), rows.column("n").to_numpy(), buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_words, bucket, padded_to, batch (number inside the bucket) and place (inside the batch)."""
    lengths = c.staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                                   word_count(F.col("text")).alias("length")), "lengths")
    bounds = plan(lengths, buckets) or [0]
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = lengths.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("length"))).cast("int"))
    rows = rows.withColumn("padded_to", F.element_at(edges, F.col("bucket") + 1))
    blocks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = c.gapless(rows, ["bucket"], ["doc_id", "text_hash"], "slot", blocks)
    capacity = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1))), F.lit(1)).cast("long")
    return rows.select("doc_id", F.col("length").alias("n_words"), "bucket", "padded_to",
                       F.floor(F.col("slot") / capacity).cast("long").alias("batch"), (F.col("slot") % capacity).alias("place"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(c.table(spark, sf_dir, "documents"))
