"""Quality rules: n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words (maximal runs without space, tab, line feed, vertical tab, form feed, return) and word pairs are
hashed into ``BUCKETS``. Two smoothed multinomials are counted over whole tables: one over trusted texts, one
over all texts. A document's score is the mean log ratio of its n-grams. A document is rejected when
simple rules fail, or when its score lies below the threshold; the threshold is the ``QUANTILE`` of the
scores of trusted texts that pass the simple rules, less ``MARGIN``.

Null or empty text: no words, so the simple rules fail. No trusted text at all: scores are 0 and the
threshold is 0, so only the simple rules decide. Rows are judged one by one: repeated rows and repeated
or null ids get equal verdicts, other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

BUCKETS = 1 << 18
PSEUDO = 1.0  # pseudo-count of each bucket, shared by both multinomials
QUANTILE = 0.005
MARGIN = 0.2
MIN_WORDS = 50
REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _grams(t: c.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and word pair."""
    two = c.in_doc(t.doc, 2)
    pairs = c.combine(t.hashes[two], t.hashes[two + 1])
    buckets = np.concatenate((c.mix(t.hashes), pairs)) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate((t.doc, t.doc[two]))


def _features(t: c.Tokens) -> dict[str, np.ndarray]:
    n = len(t.doc_start)
    inside = np.ones(len(t.data), bool)
    inside[:] = ~c.SPACE[t.data]
    span = lambda flags: (lambda r: r[t.doc_end] - r[t.doc_start])(c.running(flags))
    chars = span(inside & ((t.data & 0xC0) != 0x80))
    symbols = span(_SYMBOL[t.data])
    start, end = c.lines(t.data)
    filled = np.searchsorted(t.starts, end) > np.searchsorted(t.starts, start)
    start, end = start[filled], end[filled]
    owner = np.searchsorted(t.doc_start, start, "right") - 1
    keys = c.combine(c.span_hash(t.data, start, end), owner.astype(np.uint64))
    _, one = np.unique(keys, return_index=True)
    dup_lines = np.bincount(owner, minlength=n) - np.bincount(owner[one], minlength=n)
    three = c.in_doc(t.doc, 3)
    keys = c.combine(t.hashes[three], t.hashes[three + 1], t.hashes[three + 2], t.doc[three].astype(np.uint64))
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = three[counts[back] > 1]
    covered = np.zeros(len(t.doc), bool)
    for k in range(3):
        covered[again + k] = True
    return {"n_words": t.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": np.bincount(t.doc[covered], minlength=n)}


def _base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > REPEAT_PERCENT * f["n_words"])


def _scores(t: c.Tokens, ratio: np.ndarray) -> np.ndarray:
    buckets, doc = _grams(t)
    n = len(t.doc_start)
    return np.bincount(doc, ratio[buckets], n) / np.maximum(np.bincount(doc, minlength=n), 1)


def log_ratio(docs: DataFrame) -> np.ndarray:
    """Log ratio of each bucket: trusted texts (``trusted`` is true) against all. Counts cover every row."""

    def count(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in c.chunks(batches):
            t = c.tokens(c.as_bytes(batch.column(0)))
            buckets, doc = _grams(t)
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            totals[0] += np.bincount(buckets, minlength=BUCKETS)
            totals[1] += np.bincount(buckets[trusted[doc]], minlength=BUCKETS)
        some = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[0][some]), pa.array(totals[1][some])],
                                         names=["bucket", "raw", "target"])

    sums = docs.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(
        count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, g in sums.collect():  # at most BUCKETS rows
        raw[b], target[b] = r, g
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + PSEUDO) / (x.sum() + PSEUDO * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def trusted_by_label(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``trusted``: some label row of the document has quality 1."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    return c.joined_flags(docs, good)


def threshold(docs: DataFrame, ratio: np.ndarray) -> float:
    """Lowest score kept, from the scores of all trusted texts that pass the simple rules."""
    if not ratio.any():
        return 0.0

    def score(batches):
        for batch in c.chunks(batches):
            t = c.tokens(c.as_bytes(batch.column(0)))
            ok = ~_base_failed(_features(t))
            yield pa.RecordBatch.from_arrays([pa.array(_scores(t, ratio)[ok])], names=["score"])

    low = docs.where("trusted").select("text").mapInArrow(score, "score double").agg(
        F.percentile_approx("score", QUANTILE, 100_000)).first()[0]
    return 0.0 if low is None else float(low) - MARGIN


def judge(docs: DataFrame, ratio: np.ndarray, least: float) -> DataFrame:
    """Features, score and verdict of every row of (doc_id, text)."""

    def run(batches):
        for batch in c.chunks(batches):
            t = c.tokens(c.as_bytes(batch.column(1)))
            f, score = _features(t), _scores(t, ratio)
            failed = _base_failed(f)
            cols = [batch.column(0), *[pa.array(x.astype(np.int64)) for x in f.values()], pa.array(failed),
                    pa.array(score), pa.array(~failed & (score >= least))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *f, "base_failed", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
             " base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, ratio: np.ndarray, least: float) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""

    def run(batches):
        for batch in c.chunks(batches):
            t = c.tokens(c.as_bytes(batch.column("text")))
            ok = ~_base_failed(_features(t)) & (_scores(t, ratio) >= least)
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    c.tuned(docs.sparkSession)
    known = trusted_by_label(docs.select("doc_id", "text"), labels)
    ratio = log_ratio(known)
    return ratio, threshold(known, ratio)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return judge(docs, *fit(docs, c.table(spark, sf_dir, "labels")))
