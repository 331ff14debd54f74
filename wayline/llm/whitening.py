"""Embedding whitening: principal components by block Jacobi-Davidson, with products that Spark sums over the rows.

The covariance is never formed.  A product with a block of columns is one job: every task
centres its vectors, multiplies and sums, and only a matrix of the block's size comes back.
The search space grows by corrections to the current Ritz vectors: solutions of the
correction equation, projected against converged and current vectors, by some steps of
MINRES, for all columns at once.  Rayleigh-Ritz on the search space gives the next Ritz
vectors; those whose residual is at the level of double precision are locked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.llm.clustering import scaled
from wayline.plans.storage import load_table, materialize

SEED = 20250311
#: A residual counts as zero at this many units of rounding of the largest eigenvalue.
RESIDUAL_UNITS = 64
#: Steps of MINRES for one correction at most.
INNER = 5
#: The search space restarts from its Ritz vectors beyond this many times the wanted number.
SPACE = 4
#: Corrections settle after a few rounds; reaching this means a fault, so it raises.
MAX_ROUNDS = 80
_EPS = np.finfo(np.float64).eps


def _orthonormal(x: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what the columns of ``x`` add to the span of the bases in ``against``."""
    x = x / np.maximum(np.linalg.norm(x, axis=0), np.finfo(np.float64).tiny)
    for _ in range(3):
        for q in against:
            x = x - q @ (q.T @ x)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        x = u[:, s > 1e-10]
    return x


def minres(apply, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Columnwise MINRES for a symmetric operator: ``apply`` takes and gives a matrix of the shape of ``rhs``; all columns move at once."""
    beta = np.linalg.norm(rhs, axis=0)
    live = beta > 0
    v = np.divide(rhs, beta, out=np.zeros_like(rhs), where=live)
    x, v_old, w, w_old = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    phi, c, s, delta, eps = beta.copy(), -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    below = np.zeros_like(beta)
    start = beta.copy()
    for _ in range(steps):
        p = apply(v) - v_old * below
        alpha = (v * p).sum(axis=0)
        p = p - v * alpha
        below = np.linalg.norm(p, axis=0)
        d = c * delta + s * alpha
        g = s * delta - c * alpha
        eps, eps_old = s * below, eps
        delta = -c * below
        gamma = np.hypot(g, below)
        ok = live & (gamma > _EPS * (np.abs(alpha) + below))
        safe = np.where(ok, gamma, 1.0)
        c, s = np.where(ok, g / safe, 1.0), np.where(ok, below / safe, 0.0)
        w_new = np.where(ok, (v - w_old * eps_old - w * d) / safe, 0.0)
        x = x + w_new * (c * phi)
        phi = np.where(ok, s * phi, phi)
        w_old, w = w, w_new
        live = ok & (below > _EPS * start) & (np.abs(phi) > 0.01 * start)
        v_old, v = v, np.divide(p, below, out=np.zeros_like(p), where=live)
        if not live.any():
            break
    return x


def jacobi_davidson(product, dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of a symmetric positive operator: values (falling), vectors as columns, and residual norms.

    ``product`` multiplies a matrix of up to 2 * ``wanted`` columns.
    """
    wanted = min(wanted, dims)
    basis = _orthonormal(np.random.default_rng(SEED).normal(size=(dims, min(dims, wanted + 2))), [])
    image = product(basis)
    locked, values, norms = np.zeros((dims, 0)), np.zeros(0), np.zeros(0)
    best, stalled = np.inf, 0
    for _ in range(MAX_ROUNDS):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        k = wanted - len(values)
        ritz, moved = basis @ y[:, :k], image @ y[:, :k]
        residual = moved - ritz * theta[:k]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max(float(values[0]) if len(values) else 0.0, float(theta[0]), np.finfo(np.float64).tiny)
        whole = basis.shape[1] + len(values) == dims  # nothing is left to search: these are the eigenpairs, up to rounding
        best, stalled = (float(size.max()), 0) if size.max() < best / 2 else (best, stalled + 1)
        right = (size <= RESIDUAL_UNITS * _EPS * top) | whole | (stalled > 4 and size.max() <= 1e-12 * top)
        done = k if right.all() else int(np.argmin(right))  # in order, so that no larger one is passed over
        if done:
            locked, values, norms = np.hstack([locked, ritz[:, :done]]), np.append(values, theta[:done]), np.append(norms, size[:done])
            best, stalled = np.inf, 0
        if len(values) == wanted:
            return values, locked, norms
        if done or basis.shape[1] >= SPACE * wanted:
            keep = min(y.shape[1], done + 2 * (k - done))
            basis, image = basis @ y[:, done:keep], image @ y[:, done:keep]
        fixed = np.hstack([locked, ritz[:, done:]])
        project = lambda z, q=fixed: z - q @ (q.T @ z)
        shift = theta[done:k]
        step = minres(lambda z, project=project, shift=shift: project(product(project(z))) - shift * project(z), project(-residual[:, done:]), INNER)
        new = _orthonormal(step, [locked, basis])
        if not new.shape[1]:  # the corrections lie in the space already: look elsewhere
            new = _orthonormal(np.random.default_rng(SEED + basis.shape[1]).normal(size=(dims, min(wanted, dims))), [locked, basis])
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    raise RuntimeError("eigenvectors did not settle")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


class Centre:
    """The number of distinct vectors and their exact sums; centres vectors without losing digits."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.whole = sums // n  # integers next to the means: what is left is exact
        self.rest = (sums - n * self.whole) / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2."""
        d = x - self.whole
        rest = self.sums - self.n * self.whole
        top = (int(np.abs(d).max(initial=0)) + 1) * self.n
        if top * top * max(1, x.shape[1]) < 1 << 62:
            d = self.n * d - rest
            return np.einsum("ij,ij->i", d, d).tolist()
        d = self.n * d.astype(object) - rest.astype(object)
        return (d * d).sum(axis=1).tolist()


class Spread:
    """Sums over all distinct vectors of a table (column ``x``), each by one job."""

    def __init__(self, fit: DataFrame, dims: int):
        rows = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()  # a row per dimension
        sums = np.zeros(dims, np.int64)
        for r in rows:
            sums[r["i"]] = r["s"]
        self.fit, self.centre = fit, Centre(int(rows[0]["n"]), sums)

    def _summed(self, of, width: int) -> np.ndarray:
        """The sum over all batches of ``of(centred vectors)``, a matrix of ``width`` columns."""
        centre = self.centre
        names = [f"c{j}" for j in range(width)]

        def run(batches):
            total = None
            for b in batches:
                part = of(centre.centred(_matrix(b.column(0))))
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(total[:, j].copy()) for j in range(width))], names=["i", *names])

        parts = self.fit.select("x").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
        rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
        out = np.zeros((len(rows), width))
        for r in rows:
            out[r["i"]] = r[1:]
        return out

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times ``block``."""
        return self._summed(lambda c: c.T @ (c @ block), block.shape[1]) / self.centre.n

    def trace(self) -> float:
        return float(self._summed(lambda c: np.array([[np.einsum("ij,ij->", c, c)]]), 1)[0, 0]) / self.centre.n

    def covariance_of(self, project: np.ndarray) -> np.ndarray:
        """Covariance of the vectors times ``project``; their mean is that of the centred vectors, zero but for rounding."""
        width = project.shape[1]

        def of(c):
            w = c @ project
            return np.vstack([w.T @ w, w.sum(axis=0)])

        sums = self._summed(of, width) / self.centre.n
        return sums[:width] - np.outer(sums[width], sums[width])


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = 16, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row per remaining vector and component.

    Vectors that are null, empty or hold null or non-finite entries (or some beyond 2^31 once
    scaled) are left out, and so are vectors of another length than most have (of lengths
    as frequent: the longest).  Repeated vectors count once in the fit and keep all their
    rows; a null id is kept.  Components whose eigenvalue is zero to double precision are
    left out, as nothing can be divided by it: a table of equal vectors has no rows.  Of equal
    eigenvalues any orthonormal vectors will do.  A constant added to all entries changes
    nothing here, so the entries are used without one.  A deviation that a long can't hold is
    null.  An empty table gives an empty table; further columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vec_col).cast("array<double>"), scale).cast("array<int>").alias("x"))
    kept = materialize(kept.where("size(x) > 0"), "vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], SCHEMA)
    dims = lengths["d"]
    kept = kept.where(F.size("x") == dims)
    spread = Spread(materialize(kept.select("x").distinct(), "distinct"), dims)
    trace = spread.trace()
    values, axes, _ = jacobi_davidson(spread.product, dims, components) if trace > 0 else (np.zeros(0), np.zeros((dims, 0)), None)
    real = values > dims * _EPS * trace
    values, axes = values[real], axes[:, real]
    k = len(values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    project = axes / np.sqrt(values)
    error = float(np.abs(spread.covariance_of(project) - np.eye(k)).max())
    centre = spread.centre

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 10_000):
                part = b.slice(start, 10_000)
                x = _matrix(part.column(1))
                deviation = pa.array([d if d < 1 << 63 else None for d in centre.deviations(x)], pa.int64())
                rows, m = pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, centre.n)), deviation.take(rows), pa.array((centre.centred(x) @ project).ravel()), pa.array(np.tile(values / trace, len(x))), pa.array(np.full(m, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.select("vec_id", "x").mapInArrow(run, SCHEMA)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(load_table(spark, sf_dir, "embeddings"))
