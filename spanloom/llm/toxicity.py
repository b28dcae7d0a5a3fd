"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, trained from document labels.

A sentence is a run of text up to ``.``, ``!``, ``?`` or a line feed. Its features are hashed words (runs of ASCII
letters and bytes above 127, A-Z lower-cased), their first ``PREFIXES`` bytes and pairs of words inside the sentence. Document counts of every
hashed feature by label are taken over all labelled training rows; the ``FEATURES`` most telling ones are used. A sentence's
probability is logistic in its features; a document is toxic if any sentence is, so its probability
is 1 - prod(1 - p). Weights are fitted by gradient steps on the document log-likelihood over at most
``SAMPLE`` training rows (those with the smallest id hashes); all other steps cover every row.

Scores depend on the text alone. Null or empty texts have one empty sentence and get its probability.
Training rows: a label of 0 or 1 (the larger one if an id is labelled twice) and an id whose crc32 mod 4
is not 2. Without training rows of both labels all scores are the share of label 1 (0 without any).
Repeated rows get equal scores; other columns are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

SPACE_SIZE = 1 << 20  # hashed features
FEATURES = 1024
LEAST = 4  # training documents of label 1 that a feature needs
DEVIATIONS = 2.5  # standard errors by which a feature's log odds exceed 0
PREFIXES = (5, 7, 9)
SAMPLE = 50_000  # training rows in the fit
STEPS = 400
RATE = 0.1
DECAY = 2e-4
THRESHOLD = 0.3

_BREAKS = np.ones(256, bool)
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _BREAKS[_a:_b] = False
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


class Sentences:
    """Hashed features of texts with the sentence and document of each."""

    def __init__(self, docs: list[bytes]) -> None:
        t = self.tokens = c.tokens(docs, _BREAKS, lower=True)
        ends = c.running(_ENDS[t.data])
        number = ends[t.starts]  # sentence of each word; documents end with a line feed
        two = np.flatnonzero(number[1:] == number[:-1]) if len(number) > 1 else np.zeros(0, np.int64)
        pairs = c.combine(t.hashes[two], t.hashes[two + 1])
        heads = [np.flatnonzero(t.ends - t.starts > k) for k in PREFIXES]
        begun = [c.mix(c.span_hash(t.data, t.starts[h], t.starts[h] + k) + np.uint64(k)) for h, k in zip(heads, PREFIXES)]
        where = np.concatenate((np.arange(len(number)), two, *heads))
        self.feature = (np.concatenate((c.mix(t.hashes), pairs, *begun)) % np.uint64(SPACE_SIZE)).astype(np.int64)
        self.sentence = number[where]
        self.first = ends[t.doc_start]  # first sentence of each document
        self.count = ends[t.doc_end] - self.first + 1  # an empty rest counts: one sentence at least
        self.doc = t.doc[where]
        self.at = np.flatnonzero(_ENDS[t.data])


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(columns[::-1])
    sorted_ = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return [x[new] for x in sorted_]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows that may be learnt from."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(c.crc_of_id(), F.lit(4)) != 2)
    return c.joined_flags(docs.select("doc_id", "text"), known).where("toxic is not null")


def telling_features(train: DataFrame) -> tuple[np.ndarray, float, float]:
    """Features with the highest log odds of label 1 (at most FEATURES), and the numbers of rows by label."""

    def count(batches):
        seen = np.zeros((2, SPACE_SIZE), np.int32)
        rows = np.zeros(2, np.int64)
        for batch in c.chunks(batches):
            s = Sentences(c.as_bytes(batch.column(0)))
            label = batch.column(1).to_numpy().astype(np.int64)
            rows += np.bincount(label, minlength=2)
            doc, feature = _distinct(s.doc, s.feature)
            for k in (0, 1):
                seen[k] += np.bincount(feature[label[doc] == k], minlength=SPACE_SIZE).astype(np.int32)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[0][some], rows[0]).astype(np.int64)),
                                          pa.array(np.append(seen[1][some], rows[1]).astype(np.int64))], names=["feature", "clean", "toxic"])

    sums = c.staged(train.select("text", F.col("toxic").cast("int")).mapInArrow(
        count, "feature long, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "features")  # at most SPACE_SIZE rows
    total = sums.where("feature = -1").select("clean", "toxic").first()
    clean, toxic = (float(total[0] or 0), float(total[1] or 0)) if total else (0.0, 0.0)
    if not clean or not toxic:
        return np.zeros(0, np.int64), clean, toxic
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = sums.where((F.col("feature") >= 0) & (F.col("toxic") >= LEAST)).select("feature", (odds / error).alias("z"), odds.alias("odds")).where(
        F.col("z") > DEVIATIONS).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    c.drop_staged(sums)
    return np.sort(np.array([r["feature"] for r in best], np.int64)), clean, toxic


def _compact(s: Sentences, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence, index in chosen), without repeats, of features in use."""
    if not len(chosen):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.minimum(np.searchsorted(chosen, s.feature), len(chosen) - 1)
    hit = chosen[at] == s.feature
    return tuple(_distinct(s.doc[hit], s.sentence[hit], at[hit]))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _doc_scores(doc, sentence, index, count, weights, bias):
    """Noisy-or probability of each document, with what its gradient needs."""
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
    group = np.cumsum(new) - 1
    logit = np.bincount(group, weights[index], new.sum()) + bias
    owner = doc[new]
    busy = np.bincount(owner, minlength=len(count))
    clean = np.log1p(-_sigmoid(logit))
    log_clean = np.bincount(owner, clean, len(count)) + (count - busy) * np.log1p(-_sigmoid(bias))
    return 1 - np.exp(np.minimum(log_clean, 0)), group, owner, logit, busy


def fit(train: DataFrame, chosen: np.ndarray, clean: float, toxic: float) -> tuple[np.ndarray, float]:
    """Weights of the chosen features and the bias, from a bounded sample of training rows."""

    def compact(batches):
        for batch in c.chunks(batches):
            s = Sentences(c.as_bytes(batch.column(0)))
            doc, sentence, index = _compact(s, chosen)
            cut = np.searchsorted(doc, np.arange(len(s.count) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (sentence, index)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s.count), *lists], names=["toxic", "n", "sentence", "index"])

    picked = train.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, 1.1 * SAMPLE / max(1.0, clean + toxic))  # narrows the rows before the exact limit
    picked = picked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text", "toxic").mapInArrow(
        compact, "toxic int, n long, sentence array<int>, index array<int>").limit(SAMPLE)
    rows = picked.toArrow()
    label = rows.column("toxic").to_numpy().astype(float)
    count = rows.column("n").to_numpy().astype(float)
    size = np.array([len(x) for x in rows.column("index").to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(label)), size)
    flat = lambda k: np.concatenate([np.asarray(x.flatten()) for x in rows.column(k).chunks] or [np.zeros(0)]).astype(np.int64)
    sentence, index = flat("sentence"), flat("index")
    params = np.zeros(len(chosen) + 1)
    params[-1] = -6.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        p, group, owner, logit, busy = _doc_scores(doc, sentence, index, count, params[:-1], params[-1])
        slope = np.where(label > 0, (1 - p) / np.maximum(p, 1e-9), -1.0)  # d log-likelihood / d log-odds of a sentence
        of_sentence = slope[owner] * _sigmoid(logit)
        grad = np.append(np.bincount(index, of_sentence[group], len(chosen)),
                         of_sentence.sum() + (slope * (count - busy)).sum() * _sigmoid(params[-1])) / max(1, len(label))
        grad[:-1] -= DECAY * params[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return params[:-1], float(params[-1])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    c.tuned(docs.sparkSession)
    train = training_rows(docs, labels)
    chosen, clean, toxic = telling_features(train)
    if not len(chosen):
        rate = min(max(toxic / max(1.0, clean + toxic), 1e-9), 1 - 1e-9)
        return chosen, np.zeros(0), float(np.log(rate / (1 - rate))) if toxic else -30.0
    return (chosen, *fit(train, chosen, clean, toxic))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score and the most offending sentence: byte span in the text, probability and its share of all."""
    chosen, weights, bias = model

    def run(batches):
        for batch in c.chunks(batches):
            s = Sentences(c.as_bytes(batch.column(1)))
            doc, sentence, index = _compact(s, chosen)
            p, _, owner, logit, _ = _doc_scores(doc, sentence, index, s.count.astype(float), weights, bias)
            if not len(chosen):
                p = np.full(len(s.count), _sigmoid(bias))
            new = np.ones(len(doc), bool)
            if len(doc):
                new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
            number = sentence[new]
            order = np.lexsort((number, -logit, owner))
            first = np.flatnonzero(np.diff(owner[order], prepend=-1)) if len(order) else order
            best = order[first]
            start = np.full(len(p), -1, np.int64)
            end, worst = start.copy(), np.full(len(p), _sigmoid(bias))
            who = owner[best]
            inner = number[best] > s.first[who]
            start[who] = np.where(inner, s.at[np.maximum(number[best] - 1, 0)] + 1, s.tokens.doc_start[who]) - s.tokens.doc_start[who]
            end[who] = s.at[np.minimum(number[best], len(s.at) - 1)] - s.tokens.doc_start[who]
            worst[who] = _sigmoid(logit[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (p, start, end, worst))],
                                             names=["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, score double, worst_start long, worst_end long, worst_score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, c.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.pmod(c.crc_of_id(), F.lit(4)) == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")
