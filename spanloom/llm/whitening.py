"""Whitening of embeddings by leading covariance eigenvectors from a matrix-free Jacobi-Davidson iteration.

The covariance is never formed: Spark multiplies it with a block of vectors as sum over rows of (x - m) ((x - m) . w), centred before
multiplying, in one pass whose tasks send one partial block each. The iteration keeps a search space, takes Ritz pairs of it (Rayleigh-Ritz), and widens
it by the solutions of the correction equations, which MINRES solves in the complement of the pair and of the locked pairs. The equations of all
open pairs advance together, so an inner step is one pass whatever their number. A pair whose residual is down at double precision is
locked, in falling order; the work ends when all are locked. The driver holds blocks of (dimensions x some tens) numbers, whatever the rows.

Entries become whole numbers, floor(256 * entry), and each distinct vector counts once in the fit; repeated vectors meet in a partially aggregated
distinct. Sums and deviations are exact whole numbers.

Rows whose vector is null, empty or holds null or non-finite entries are left out, and so are vectors whose length is not the commonest one (the
shortest of equally common ones). Rows with a null or repeated vec_id are rows of their own. A deviation beyond a long is null; a component without
variance has a null whitened value, and its explained share is 0 (null where no component has any). Fewer than four dimensions give as many components.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

COMPONENTS = 4
SCALE = 256
GUARD = 8  # Ritz pairs beyond the wanted ones that are kept and corrected too: a pass costs about the same for some more columns
INNER = 3  # MINRES steps of one correction at most
FORCING = 0.05  # a correction ends when its residual is down to this share
SPACE = 48  # search space at which it restarts
OUTER = 200
SEED = 12

Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Whitening:
    """Exact counts and sums of the fit list, leading eigenpairs of its covariance, and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions x components
    values: np.ndarray
    trace: float
    error: float | None
    products: int  # passes over the fit list

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def varied(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)


def _whole(vectors: DataFrame) -> DataFrame:
    entries = F.col("embedding").cast("array<double>")
    usable = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull()).where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, lambda x: F.floor(x * SCALE)).alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums: entries are added as two halves, so that no sum of longs overflows."""

    def run(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(high), dtype=np.int32), "n": np.full(len(high), n), "high": high, "low": low})

    big = [F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in ("n", "high", "low")]
    rows = sorted(fit.mapInArrow(run, "at int, n long, high long, low long").groupBy("at").agg(*big).collect())
    return int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _reduced(fit: DataFrame, mean: np.ndarray, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all batches of ``work`` on the centred rows: an array of ``size`` numbers, one partial array a task."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_matrix(batch.column("x")) - mean).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "value": total})

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what the block adds to the spaces in ``against``; columns that add nothing are left out."""
    kept: list[np.ndarray] = []
    for k in range(block.shape[1]):
        v = block[:, k].copy()
        size = np.linalg.norm(v)
        for _ in range(3):
            for space in against:
                v -= space @ (space.T @ v)
            for u in kept:
                v -= u * (u @ v)
        if size > 0 and np.linalg.norm(v) > 1e-10 * size:
            kept.append(v / np.linalg.norm(v))
    return np.stack(kept, axis=1) if kept else np.zeros((len(block), 0))


def _corrections(product: Product, pairs: np.ndarray, values: np.ndarray, residuals: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """MINRES on (I - QQ')(A - value I)(I - QQ') t = -r for every pair at once; Q holds the locked vectors and the pair."""

    def outside(p):
        p = p - locked @ (locked.T @ p)
        return p - pairs * (pairs * p).sum(axis=0)

    dot = lambda a, b: (a * b).sum(axis=0)
    safe = lambda a: np.where(a > 0, a, 1.0)
    b = -outside(residuals)
    beta = np.sqrt(dot(b, b))
    start, eta, live = beta.copy(), beta.copy(), beta > 0
    v, v_old = b / safe(beta), np.zeros_like(b)
    w, w_old, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    cos, cos_old, sin, sin_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(INNER):
        if not live.any():
            break
        z = outside(v)
        z = outside(product(z) - z * values)
        alpha = dot(v, z)
        z = z - v * alpha - v_old * beta
        beta_new = np.sqrt(dot(z, z))
        delta = cos * alpha - cos_old * sin * beta
        r1, r2, r3 = np.hypot(delta, beta_new), sin * alpha + cos_old * cos * beta, sin_old * beta
        live &= r1 > 0
        w, w_old = np.where(live, (v - w_old * r3 - w * r2) / safe(r1), 0.0), w
        cos_old, cos, sin_old, sin = cos, delta / safe(r1), sin, beta_new / safe(r1)
        x = x + np.where(live, w * cos * eta, 0.0)
        eta = -sin * eta
        live &= (np.abs(eta) > FORCING * start) & (beta_new > 0)
        v_old, v, beta = v, z / safe(beta_new), beta_new
    return outside(x)


def jacobi_davidson(product: Product, dim: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues, falling, and unit eigenvectors of a symmetric positive operator given by its products."""
    rng = np.random.default_rng(SEED)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    space = _orthonormal(rng.normal(size=(dim, min(dim, want + GUARD))))
    image = product(space)
    best, stale = np.inf, 0
    for _ in range(OUTER):
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn  # the space in its Ritz base
        residual = image - space * ritz
        size = np.linalg.norm(residual, axis=0)
        top = max(np.abs(ritz).max(), values.max(initial=0.0))
        # double precision: the rounding of a product of this size; what no longer falls has reached its rounding
        limit = dim * np.finfo(float).eps * top
        stale = 0 if size[0] < best / 2 else stale + 1
        best = min(best, size[0])
        done = 0
        while done < want - locked.shape[1] and (size[done] <= limit or (stale >= 4 and done == 0 and size[0] <= 1e3 * limit)):
            done += 1
        if done:
            locked, values = np.concatenate([locked, space[:, :done]], axis=1), np.concatenate([values, ritz[:done]])
            space, image, residual, ritz = space[:, done:], image[:, done:], residual[:, done:], ritz[done:]
            best, stale = np.inf, 0
        left = want - locked.shape[1]
        if not left:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        fresh = _orthonormal(rng.normal(size=(dim, left)), locked, space)
        if space.shape[1]:
            open_pairs = slice(0, min(left + GUARD, space.shape[1]))
            steps = _corrections(product, space[:, open_pairs], ritz[open_pairs], residual[:, open_pairs], locked)
            fresh = _orthonormal(steps, locked, space) if np.any(steps) else fresh
        if space.shape[1] + fresh.shape[1] > max(SPACE, 2 * want + GUARD):
            space, image = space[:, :left + GUARD], image[:, :left + GUARD]
        if fresh.shape[1]:
            space, image = np.concatenate([space, fresh], axis=1), np.concatenate([image, product(fresh)], axis=1)
            space = space - locked @ (locked.T @ space)
    raise ArithmeticError(f"no eigenpairs at double precision after {OUTER} steps")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Mean and leading eigenpairs of the distinct vectors; None if there are none."""
    c.tuned(vectors.sparkSession)
    rows = _whole(vectors)
    usual = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return None
    dim = usual["dim"]
    want = min(components, dim)
    listed = c.staged(rows.where(F.size("x") == dim).select("x").distinct(), "fit-vectors")
    n, sums = _sums(listed)
    mean = np.array([s / n for s in sums])
    passes = [0]

    def product(block: np.ndarray) -> np.ndarray:
        passes[0] += 1
        return _reduced(listed, mean, block.size, lambda x: x.T @ (x @ block)).reshape(block.shape) / n

    trace = float(_reduced(listed, mean, 1, lambda x: np.array([(x * x).sum()]))[0]) / n
    values, base = jacobi_davidson(product, dim, want)
    model = Whitening(n, sums, base, values, trace, None, passes[0])
    some = np.flatnonzero(model.varied)
    if len(some):
        turn = base[:, some] / np.sqrt(values[some])
        middle = _reduced(listed, mean, len(some), lambda x: (x @ turn).sum(axis=0)) / n

        def spread(x):
            y = x @ turn - middle
            return y.T @ y

        cov = _reduced(listed, mean, len(some) ** 2, spread).reshape(len(some), -1) / n
        model.error = float(np.abs(cov - np.eye(len(some))).max())
    c.drop_staged(listed)
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component."""
    dim, k = model.vectors.shape
    mean, some = model.mean, model.varied
    turn = np.where(some, model.vectors / np.sqrt(np.where(some, model.values, 1.0)), 0.0)
    share = [max(float(v), 0.0) / model.trace if model.trace > 0 else None for v in model.values]
    n, sums = model.n, model.sums
    most, top = max(map(abs, sums)), (1 << 63) - 1
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column("x"))
            if (n * int(np.abs(x.astype(float)).max() + 1) + most) ** 2 * dim < top:
                deviation = ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d <= top else None for d in ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)]
            y = (x - mean) @ turn
            flat = pa.array(y.ravel(), mask=np.tile(~some, m))
            take = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(take)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 pa.array(deviation, pa.int64()).take(pa.array(take)), flat, pa.array(share * m, pa.float64()),
                 pa.array([model.error] * (m * k), pa.float64())], schema=schema)

    rows = _whole(vectors).where(F.size("x") == dim)
    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = c.table(spark, sf_dir, "embeddings")
    model = fit(vectors)
    if model is None:
        model = Whitening(1, [0], np.zeros((1, 1)), np.zeros(1), 0.0, None, 0)  # no usable row: nothing to whiten
    return whiten(vectors, model)
