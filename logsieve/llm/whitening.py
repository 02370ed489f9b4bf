"""Embedding whitening by Jacobi-Davidson, without ever forming the covariance.

Vectors are turned into whole numbers, so sums and deviations from the mean are exact: x is the fixed-point
form of a vector, n the number of different x (the fit list), S their sum, and n * x - S is n times the centred
vector, computed in 64-bit integers before anything is multiplied.

The leading eigenvectors of the covariance come from a block Jacobi-Davidson iteration:

1. The search space's Ritz pairs are found on the driver from its products with the covariance.
2. Each wanted pair whose residual has reached double precision is locked and leaves the search space.
3. Every other pair (u, t) gets a correction s from (I - QQ')(A - tI)(I - QQ') s = -r, where Q holds the locked and
   the current Ritz vectors. MINRES solves these equations roughly and in step with each other, so that one
   distributed product serves all of them.
4. Corrections are made orthogonal to all before and extend the space; a full space restarts from its best pairs.

A product A v is one pass over the fit list: each task centres its rows and adds up c (c . v). Spark sums what
the tasks found, so the driver sees numbers of dimensions times columns only, and a lost executor costs its tasks.

Rows whose vector is null or has null, NaN or infinite entries are dropped; so are entries beyond LARGEST in size
(they have no fixed-point form) and vectors whose length isn't the most frequent one (the longer, if tied).
Repeated vectors count once in the fit list and get the same result in every row; null ids stay null. Components without
variance (fewer different vectors than components, or constant ones) are left out; deviations beyond 64 bits are null.
An empty table, or one without variance, gives an empty result.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.sources import store

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 40)
#: Vectors beyond the wanted ones in the first search space, and how many blocks it may grow to.
GUARD, BLOCKS = 4, 4
#: Steps of the inner solver, and the share of a residual at which it stops; a limit on outer steps.
INNER, ENOUGH, OUTER = 12, 0.05, 200
EPS = float(np.finfo(float).eps)


def fixed_point(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of every entry; null if one has none."""
    wide = vector.cast("array<double>")
    good = F.forall(wide, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return F.when(good, F.transform(wide, lambda c: F.floor(c * SCALE) + SHIFT))


def _rows(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class FitList:
    """The different vectors, as a written table, and their number and sum."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.dim = dim
        self.table = store.materialize(vectors.select("x").distinct(), "fit-list")
        self.n = self.table.count()
        self.sum = self.total(lambda x: x.sum(0), dim, "long", centred=False)

    def total(self, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double", centred: bool = True) -> np.ndarray:
        """Sum over the fit list of what ``of`` gives for parts of it (n * x - S, or x, in rows), an array of ``size`` numbers."""
        dim, n, s = self.dim, np.int64(self.n if centred else 1), self.sum if centred else np.int64(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = 0
            for b in batches:
                if b.num_rows:
                    out = out + of(_rows(b, dim) * n - s)
            flat = np.ravel(out) if np.ndim(out) else np.zeros(0, np.int64 if kind == "long" else float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["pos", "value"])

        got = self.table.mapInArrow(run, f"pos int, value {kind}").groupBy("pos").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size, np.int64 if kind == "long" else float)
        out[got["pos"].to_numpy()] = got["value"].to_numpy()
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """The covariance times the columns of v."""
        n = self.n

        def of(c: np.ndarray) -> np.ndarray:
            centred = c / n
            return centred.T @ (centred @ v)

        return self.total(of, v.size).reshape(v.shape) / n

    def trace(self) -> float:
        n = self.n
        return float(self.total(lambda c: np.array([((c / n) ** 2).sum()]), 1)[0]) / n


def minres(times: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int = INNER, enough: float = ENOUGH) -> np.ndarray:
    """Solutions of a symmetric system for each column of rhs, all columns in step; roughly, by so many steps at most."""
    x, first = np.zeros_like(rhs), np.linalg.norm(rhs, axis=0)
    before, now = rhs.copy(), rhs.copy()
    y, beta, old = rhs.copy(), first.copy(), np.ones_like(first)
    w, w_before = np.zeros_like(rhs), np.zeros_like(rhs)
    dbar, eps_, left = np.zeros_like(first), np.zeros_like(first), first.copy()
    cs, sn = -np.ones_like(first), np.zeros_like(first)
    for k in range(steps):
        live = (beta > EPS * first) & (left > enough * first)
        if not live.any():
            break
        v = np.where(live, y / np.where(beta > 0, beta, 1), 0)
        y = times(v)
        if k:
            y -= beta / old * before
        alpha = (v * y).sum(0)
        y -= alpha / np.where(beta > 0, beta, 1) * now
        before, now, old = now, y.copy(), np.where(beta > 0, beta, 1)
        beta = np.linalg.norm(y, axis=0)
        eps_before, delta, gbar = eps_, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps_, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), EPS)
        cs, sn = gbar / gamma, beta / gamma
        step, left = cs * left, np.where(live, sn * left, left)
        new = (v - eps_before * w_before - delta * w) / gamma
        w_before, w = w, new
        x += np.where(live, step * new, 0)
    return x


def _orthonormal(new: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to the bases before."""
    old = np.hstack(before) if before else new[:, :0]
    for _ in range(2):
        new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
        new = new - old @ (old.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * max(1e-300, s.max(initial=0))] if s.size and s.max() > 1e-10 else new[:, :0]
    return new


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), unit eigenvectors (columns) and residual norms of a symmetric positive operator's ``wanted`` largest."""
    rng, wanted = np.random.default_rng(seed), min(wanted, dim)
    locked, values, norms = np.zeros((dim, 0)), np.zeros(0), np.zeros(0)
    v = _orthonormal(rng.standard_normal((dim, min(dim, wanted + GUARD))))
    w = times(v)
    best = np.inf
    for _ in range(OUTER):
        g = v.T @ w
        theta, s = np.linalg.eigh((g + g.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = v @ s, w @ s
        u, au = u - locked @ (locked.T @ u), au
        r = au - u * theta
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        top = max([*values, *theta[:1], 0.0])
        reach = max(0, wanted - len(values))
        # as far as sums of this length are exact; or no better than the step before, and close to it
        tight = 16 * EPS * np.sqrt(dim) * top
        done = size <= tight
        worst = size[:reach].max(initial=0)
        if worst <= 64 * tight and worst >= best / 2:
            done |= size <= 64 * tight
        best = worst
        # locked from the largest on, also if it overtakes one locked before
        over = int((theta > values.min(initial=np.inf)).sum()) if reach == 0 else reach
        fixed = np.flatnonzero(done[:over])
        if len(fixed):
            locked = np.hstack([locked, u[:, fixed] / np.linalg.norm(u[:, fixed], axis=0)])
            values, norms = np.concatenate([values, theta[fixed]]), np.concatenate([norms, size[fixed]])
            rest = np.setdiff1d(np.arange(len(theta)), fixed)
            u, au, r, theta = u[:, rest], au[:, rest], r[:, rest], theta[rest]
            best = np.inf
        if len(values) >= wanted and not (theta > np.sort(values)[::-1][wanted - 1]).any():
            break
        if not len(theta):
            break
        ask = min(len(theta), max(1, wanted - len(values)))
        q = np.hstack([locked, u[:, :ask]])
        shift = theta[:ask]

        def projected(x: np.ndarray, q=q, shift=shift) -> np.ndarray:
            x = x - q @ (q.T @ x)
            y = times(x) - x * shift
            return y - q @ (q.T @ y)

        if v.shape[1] > BLOCKS * (wanted + GUARD):
            keep = min(len(theta), wanted + GUARD)
            u, au = u[:, :keep], au[:, :keep]
        v, w = u, au
        if v.shape[1] + locked.shape[1] < dim:
            steps = minres(projected, -r[:, :ask])
            more = _orthonormal(steps, locked, v)
            if not more.shape[1]:
                more = _orthonormal(rng.standard_normal((dim, 1)), locked, v)
            v, w = np.hstack([v, more]), np.hstack([w, times(more)])
        else:  # the space is full: only rounding is left, which fresh products remove
            v = _orthonormal(v, locked)
            w = times(v)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], locked[:, order], norms[order]


def whiten(rows: DataFrame, vector: str = "embedding", wanted: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row of rows (vec_id, vector) and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    vectors = rows.select(F.col("vec_id").cast("long"), fixed_point(F.col(vector)).alias("x")).where("x is not null")
    sizes = vectors.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None or not most["size"]:
        return spark.createDataFrame([], schema)
    dim = most["size"]
    vectors = vectors.where(F.size("x") == dim)
    fit = FitList(vectors, dim)
    trace = fit.trace()
    values, u, _ = leading(fit.times, dim, wanted) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)), None)
    real = values > EPS * dim * trace
    values, u = values[real], u[:, real]
    k, n, s = len(values), fit.n, fit.sum
    if not k:
        return spark.createDataFrame([], schema)
    project = u / np.sqrt(values)

    def moments(c: np.ndarray) -> np.ndarray:
        z = (c / n) @ project
        return np.vstack([z.T @ z, z.sum(0)])

    got = fit.total(moments, (k + 1) * k).reshape(k + 1, k) / n
    error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                c = _rows(part, dim) * n - s
                m = len(c)
                with np.errstate(over="ignore"):
                    exact = (c * c).sum(1)
                wide = (c.astype(float) ** 2).sum(1) >= 2.0**63
                z = (c / n) @ project
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), pa.array(np.repeat(exact, k), mask=np.repeat(wide, k)), pa.array(z.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, schema)
