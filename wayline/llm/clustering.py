"""Centroid clustering in exact integers: Lloyd's rounds, with nearest centroids found by Orchard's search.

Every centroid has a list of the other centroids by rising distance.  A vector starts at one
centroid and walks down that centroid's list; at a closer centroid it goes on with that one's
list, and it stops where the list's distances exceed twice its own, as nothing beyond can be
closer (triangle inequality).  Vectors stay where they are: a round sends the centroids and
their lists to all tasks, which return sums by cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.plans.storage import load_table, materialize

#: The lists of k centroids hold k^2 entries and go to every task.
MAX_CENTROIDS = 4096
#: Beyond this size a component is no longer handled as a 64-bit number's square root.
LARGEST = 1 << 31
#: Rows times centroids that a step of a task marks as visited or not.
STEP_MARKS = 4_000_000


def scaled(vec: Column, scale: float, largest: int = LARGEST) -> Column:
    """floor(scale * x) of every component as longs; null if one is null, not finite or scaled beyond ``largest``."""
    fine = F.forall(vec, lambda x: F.coalesce(F.abs(x) * scale < float(largest), F.lit(False)))  # false for NaN, which is above all numbers
    return F.when(fine, F.transform(vec, lambda x: F.floor(x * scale)))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays; Python integers where 64 bits might not do."""
    d = x - c
    top = int(np.abs(d).max(initial=0))
    if top * top * max(1, x.shape[1]) < 1 << 63:
        return np.einsum("ij,ij->i", d, d)
    d = d.astype(object)
    return (d * d).sum(axis=1)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centroid: the others by rising squared distance, and these distances."""
    k = len(centroids)
    dist = np.array([_squared(centroids, np.broadcast_to(c, centroids.shape)) for c in centroids]).reshape(k, k)
    order = np.array([[j for j in sorted(range(k), key=lambda j, row=row: (row[j], j)) if j != i] for i, row in enumerate(dist)], dtype=np.int64).reshape(k, k - 1)
    return order, np.take_along_axis(dist, order, axis=1)


def orchard(x: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of ``x`` (of several: the smallest number) and the squared distance; all rows walk at once."""
    order, apart = lists
    n, k = len(x), len(centroids)
    best = np.zeros(n, np.int64)
    dist = _squared(x, centroids[best])
    if k == 1 or not n:
        return best, dist
    at, visited = np.zeros(n, np.int64), np.zeros((n, k), bool)
    visited[:, 0] = True
    rows = np.arange(n)
    while len(rows):
        here = best[rows]
        step = apart[here, at[rows]]
        own = dist[rows]
        # A centroid at exactly twice the distance may tie, so the walk stops strictly beyond; quarters keep this exact in 64 bits.
        goes = (step + 3) // 4 <= own
        rows, here = rows[goes], here[goes]
        to = order[here, at[rows]]
        new = ~visited[rows, to]
        at[rows] += 1
        seen, cand = rows[new], to[new]
        visited[seen, cand] = True
        d = _squared(x[seen], centroids[cand])
        if d.dtype == object and dist.dtype != object:
            dist = dist.astype(object)
        closer = (d < dist[seen]) | ((d == dist[seen]) & (cand < best[seen]))
        jump = seen[closer]
        best[jump], dist[jump], at[jump] = cand[closer], d[closer], 0
        rows = rows[at[rows] < k - 1]
    return best, dist


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _assigned(batches, column: int, centroids: np.ndarray):
    """Runs of rows with their clusters and distances."""
    lists = neighbour_lists(centroids)
    step = max(1, STEP_MARKS // len(centroids))
    for b in batches:
        for start in range(0, b.num_rows, step):
            part = b.slice(start, step)
            x = _matrix(part.column(column))
            yield part, x, *orchard(x, centroids, lists)


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest, in order; null ids come last, equal hashes by vector."""
    top = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    return np.array([r["x"] for r in top.collect()], dtype=np.int64)


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the exact mean of each cluster; an empty cluster keeps its centroid."""

    def sums(batches):
        k, dims = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x, best, _ in _assigned(batches, 0, centroids):
            n += np.bincount(best, minlength=k)
            np.add.at(total, best, x)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(has, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(has))), pa.array(total[has].ravel()), pa.array(np.repeat(n[has], dims))], names=["cluster", "dim", "total", "n"]
        )

    parts = kept.select("x").mapInArrow(sums, "cluster int, dim int, total long, n long")
    exact = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in exact.collect():  # k x dims rows at most
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def centroid_clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, dims: int = 64, seed: str = "3", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, a row per vector that is kept.

    Vectors that are null, of another length than ``dims``, or hold null or non-finite
    components (or some beyond 2^31 once scaled) are left out.  With fewer than ``k`` vectors
    each is a first centroid.  Repeated rows are vectors of their own and take equal clusters;
    ties go to the smaller number; a null id is kept but comes last as a first centroid.  A
    distance that a long can't hold is null.  An empty table gives an empty table; further
    columns are ignored.
    """
    if not 1 <= k <= MAX_CENTROIDS:
        raise ValueError(f"k is 1 to {MAX_CENTROIDS}")
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.size(vec) == dims, scaled(vec, scale)).alias("x")).where("x is not null")
    kept = materialize(kept, "vectors")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)

    def assign(batches):
        for part, _, best, dist in _assigned(batches, 1, centroids):
            fits = pa.array([int(d) if d < 1 << 63 else None for d in dist], pa.int64()) if dist.dtype == object else pa.array(dist)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), fits], names=["vec_id", "cluster", "distance"])

    clusters = materialize(kept.select("vec_id", "x").mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"] or 0) for r in clusters.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    fits = lambda v: v if v < 1 << 63 else None
    facts = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    return clusters.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(load_table(spark, sf_dir, "embeddings"))


def oracle(k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: str = "3") -> str:
    """The same clusters in SQL: every round compares all vectors with all centroids; ids are unique there."""
    fine = f"embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
    step = f"""a{{r}} AS MATERIALIZED (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.x, m.c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - m.y[i]) * (v.x[i] - m.y[i])))::bigint AS d FROM v, m{{r}} m) GROUP BY vec_id, x)"""
    move = """m{next} AS MATERIALIZED (SELECT c, coalesce(n.y, m.y) AS y FROM m{r} m LEFT JOIN (SELECT c, list(y ORDER BY i) AS y FROM (SELECT c, i, ((s - (s % n + n) % n) // n)::bigint AS y FROM (SELECT c, i, sum(e)::hugeint AS s, count(*)::hugeint AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c) n USING (c))"""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) AS x FROM embeddings WHERE {fine})",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y FROM (SELECT x, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [step.format(r=r), move.format(r=r, next=r + 1)]
    parts.append(step.format(r=rounds))
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, c::int AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::bigint AS cluster_inertia, sum(d) OVER ()::bigint AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} JOIN m{rounds} USING (c)"
    )
