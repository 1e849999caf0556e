"""Whitening of embedding vectors: the leading principal components by block Jacobi-Davidson over distributed products.

The covariance is never formed. Every product with it is one pass over the vectors: a task centres its rows, multiplies them
with the block and back, and sends one partial sum; partial sums are added in a second, smaller stage. The driver holds only
blocks of dimension x subspace. Each round does

* Rayleigh-Ritz in the search space; leading pairs whose residual is at rounding level are locked and deflated;
* one projected correction equation per open pair, solved by MINRES for all pairs at once (one pass per step);
* orthogonalisation of the corrections into the search space, with a restart from the best Ritz vectors when it is full.
"""
from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
MOST = 1 << 62               # x saturates here
ROUNDING = 32 * np.finfo(float).eps
INNER = 4                    # MINRES steps of one correction
STALLED = 4                  # rounds without progress after which a residual below NOISE is rounding of the products
NOISE = 1e-11
FAN_IN = 64                  # partial sums that are added without a stage of their own


# ---- vectors ------------------------------------------------------------------------------
def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x of all rows, offsets, whether the row is usable): x = floor(64 c) + 1000000; rows that are NULL or hold NULL or
    non-finite entries are not usable."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    flat = column.flatten()
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64)     # NULL becomes NaN
    finite = np.isfinite(c)
    bad = np.concatenate(([0], np.cumsum(~finite)))
    usable = (bad[at[1:]] == bad[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        y = np.clip(np.floor(SCALE * np.where(finite, c, 0.0)), -float(MOST), float(MOST) - SHIFT - 512)
    return y.astype(np.int64) + SHIFT, at, usable


def prepared(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, d, x): usable rows."""
    kind = vectors.schema[id_column].dataType.simpleString()

    def run(batches):
        for b in batches:
            x, at, usable = scaled(b.column(1))
            keep = pa.array(usable)
            values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)).filter(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(np.diff(at)[usable].astype(np.int32)), values],
                                             ["id", "d", "x"])

    return vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(
        run, f"id {kind}, d int, x array<long>")


def matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def dimension_sums(batches):
    """(d, i, n, s): exact sums of entry i over the task's vectors of d entries."""
    total: dict[int, list] = {}
    for b in batches:
        sizes = b.column("d").to_numpy()
        for d in np.unique(sizes).tolist():
            if d:
                x = matrix(b.filter(pa.array(sizes == d)), d)
                part = [int(h) * (1 << 31) + int(low) for h, low in zip((x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0))]
                n, s = total.get(d, (0, [0] * d))
                total[d] = [n + len(x), [p + q for p, q in zip(s, part)]]
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
             pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], ["d", "i", "n", "s"])


class Centre:
    """The mean S/n as an integer and a fraction, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d, self.sums = n, len(sums), sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.fraction = np.array([(s % n) / n for s in sums])
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 by row, exactly; None beyond a long. Integers that wrap are right as long as the sum fits."""
        with np.errstate(over="ignore"):
            y = np.int64(self.n) * (x - self.whole) - self.rest
            exact = (y * y).sum(axis=1)
        about = ((self.n * self(x)) ** 2).sum(axis=1)
        out = exact.tolist()
        for i in np.flatnonzero(about > 9.2e18):
            value = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            out[i] = value if value < 1 << 63 else None
        return out


# ---- distributed sums -----------------------------------------------------------------------
def added(batches):
    total = None
    for b in batches:
        for blob in b.column("m"):
            part = np.frombuffer(blob.as_py())
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])


def gathered(rows: DataFrame, per_batch: Callable[[np.ndarray], np.ndarray], d: int, size: int) -> np.ndarray:
    """Sum over all batches of vectors of ``per_batch`` (flat arrays of ``size`` doubles): one partial sum by task, added by
    about sqrt(tasks) tasks before the driver adds the rest."""
    def run(batches):
        from pyspark import TaskContext
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += per_batch(matrix(b, d))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    parts = rows.mapInArrow(run, "part int, m binary")
    tasks = rows.rdd.getNumPartitions()
    if tasks > FAN_IN:
        parts = parts.repartition(ceil(sqrt(tasks)), "part").mapInArrow(added, "part int, m binary")
    total = np.zeros(size)
    for blob in parts.select("m").toArrow().column("m"):
        total += np.frombuffer(blob.as_py())
    return total


class Covariance:
    """Products with the covariance; each also finds the trace and the (rounding) mean of the centred vectors."""

    def __init__(self, rows: DataFrame, centre: Centre):
        self.rows, self.centre, self.passes = rows, centre, 0
        self.trace, self.drift = 0.0, np.zeros(centre.d)

    def __call__(self, block: np.ndarray) -> np.ndarray:
        d, k = block.shape
        centre = self.centre
        sc = self.rows.sparkSession.sparkContext
        shared = sc.broadcast(np.ascontiguousarray(block))

        def partial(x):
            c = centre(x)
            return np.concatenate(((c.T @ (c @ shared.value)).ravel(), [np.vdot(c, c)], c.sum(axis=0)))

        got = gathered(self.rows, partial, d, d * k + 1 + d) / centre.n
        shared.destroy()
        self.passes += 1
        self.trace, self.drift = float(got[d * k]), got[d * k + 1:]
        return got[:d * k].reshape(d, k)


# ---- Jacobi-Davidson -------------------------------------------------------------------------
def out_of(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The part of ``block`` orthogonal to ``basis`` (twice, against cancellation)."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def new_directions(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``block`` adds to ``basis``."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(out_of(basis, block), full_matrices=False)
    u = out_of(basis, u[:, s > 1e-8])
    return np.linalg.qr(u)[0] if u.shape[1] else u


def minres(apply, right: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """MINRES for many symmetric systems at once: ``apply`` multiplies a block, column j by its own operator. A step multiplies
    all columns together; columns stop counting when their residual is ``goal`` of the start."""
    k = right.shape[1]
    beta = np.linalg.norm(right, axis=0)
    start = beta.copy()
    safe = lambda v: np.where(v > 0, v, 1.0)
    v_old, v = np.zeros_like(right), right / safe(beta)
    w_old, w, t = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta, c_old, c, s_old, s = beta.copy(), np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    beta = np.zeros(k)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        rho1 = np.sqrt(delta ** 2 + after ** 2)
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        live = rho1 > 0
        rho1 = safe(rho1)
        c_old, c, s_old, s = c, delta / rho1, s, after / rho1
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / rho1
        t = t + np.where(live, c * eta, 0.0) * w
        eta = np.where(live, -s * eta, 0.0)
        v_old, v, beta = v, np.where(after > 0, p / safe(after), 0.0), after
        if (np.abs(eta) <= goal * start).all():
            break
    return t


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 13):
    """(values falling, vectors as columns) of the ``wanted`` largest eigenpairs of a symmetric positive operator."""
    wanted = min(wanted, d)
    width = min(d, wanted + 8)
    most = min(d, 3 * width)
    locked, values = np.zeros((d, 0)), []
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    vq = product(q)
    top, best, waited, rounds = 0.0, np.inf, 0, 0
    while True:
        h = q.T @ vq
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, vu = q @ y, vq @ y
        top = max([top, *theta[:1].tolist()])
        need = wanted - len(values)
        off = np.linalg.norm(out_of(locked, vu[:, :need] - u[:, :need] * theta[:need]), axis=0)
        whole = q.shape[1] + locked.shape[1] >= d            # nothing is left to add: the residual is rounding
        waited = 0 if off[0] < best / 2 else waited + 1
        best = min(best, off[0])
        done = 0
        while done < need and (whole or off[done] <= ROUNDING * top or (waited >= STALLED and off[done] <= NOISE * top)):
            done += 1
        if done:
            locked = np.hstack((locked, u[:, :done]))
            values += theta[:done].tolist()
            best, waited = np.inf, 0
        if len(values) == wanted:
            # locked pairs are the operator's to rounding; one product settles their order and values
            h = locked.T @ product(locked)
            theta, y = np.linalg.eigh((h + h.T) / 2)
            return theta[::-1], locked @ y[:, ::-1]
        u, vu, theta, off = u[:, done:], vu[:, done:], theta[done:], off[done:]
        need = wanted - len(values)
        known = np.hstack((locked, u[:, :need]))
        shift = theta[:need]
        residual = out_of(known, vu[:, :need] - u[:, :need] * shift)
        rounds += 1
        fix = minres(lambda p: out_of(known, product(p) - p * shift), -residual, INNER, 0.5 ** rounds)
        if u.shape[1] + need > most - locked.shape[1]:
            keep = max(need, min(u.shape[1], width))
            u, vu = u[:, :keep], vu[:, :keep]
        q, vq = u, vu
        fresh = new_directions(np.hstack((locked, q)), fix)
        if not fresh.shape[1]:                                # corrections lie in the space: any direction helps
            fresh = new_directions(np.hstack((locked, q)), np.random.default_rng(seed + rounds).standard_normal((d, 1)))
        fresh = fresh[:, :d - locked.shape[1] - q.shape[1]]
        if fresh.shape[1]:
            q, vq = np.hstack((q, fresh)), np.hstack((vq, product(fresh)))


# ---- the operator ------------------------------------------------------------------------------
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and leading component.

    Rows whose vector is NULL, or holds NULL or non-finite entries, are dropped; so are vectors shorter than the longest (they
    lack entries) and empty ones. Repeated rows and NULL ids count like any other row. Components whose eigenvalue is
    rounding of the largest are not returned (constant dimensions, fewer vectors than dimensions), so a single vector or an
    empty table gives an empty result. Entries beyond 2^56 saturate; a ``deviation`` beyond a long is NULL. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {OUT}"
    rows = written(prepared(vectors, id_column, column), "vectors")
    sums = written(rows.select("d", "x").mapInArrow(dimension_sums, "d int, i int, n long, s decimal(38,0)")
                   .groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "vector-sums")
    d = sums.agg(F.max("d")).first()[0]
    if not d:
        return spark.createDataFrame([], schema)
    found = sorted(sums.filter(F.col("d") == d).collect(), key=lambda r: r.i)
    centre = Centre(found[0].n, [int(r.s) for r in found])
    rows = rows.filter(F.col("d") == d)
    xs = rows.select("x")
    product = Covariance(xs, centre)
    values, u = jacobi_davidson(product, d, components)
    keep = values > max(values[0], 0.0) * d * np.finfo(float).eps * 4
    values, u = values[keep], u[:, keep]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    back = u / np.sqrt(values)
    mean = product.drift @ back

    def spread(x):
        z = centre(x) @ back - mean
        return (z.T @ z).ravel()

    error = float(np.abs(gathered(xs, spread, d, k * k).reshape(k, k) / centre.n - np.eye(k)).max())
    explained = values / product.trace

    def rotated(batches):
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.slice(lo, 4096)
                x = matrix(part, d)
                m = len(x)
                if not m:
                    continue
                of = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, centre.n, np.int64)), pa.array(centre.deviation(x), pa.int64()).take(of),
                     pa.array((centre(x) @ back).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(rotated, schema)
