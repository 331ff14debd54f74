"""Embedding near-duplicates: principal coordinates, tiles, and bounds from leading dimensions.

Unit vectors are rotated to their principal axes, so that the first coordinates hold most
of a product.  A link of cosine t means a distance of at most r = sqrt(2 - 2t), so vectors
are dealt to a grid of cell width r over the first few axes, cells are split into tiles of
bounded size, and only tiles of the same or adjacent cells meet.  In a pair of tiles the
products of the leading coordinates come first; with the norms of the rest they bound the
cosine from above (Cauchy-Schwarz), and pairs that cannot reach t stop there.  The others
go on in double precision.  A pair of tiles returns link counts and a spanning forest,
never its pairs.  Equal vectors are folded to one with a count beforehand.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.llm.components import connected_components
from wayline.plans.storage import materialize

TILE = 8192
#: Leading dimensions of the first and second bound.
LEAD, NEXT = 16, 32
#: Rows and columns that are compared at a time within a pair of tiles.
STEP = 1024
#: Slack of the single-precision bound.
SLACK = 1e-4


def _units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, k, dims, unit): unit is the unit vector as doubles; null where the vector links with nothing."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                keys, dims, units = [], [], []
                for v in part.column(1).to_pylist():
                    x = None
                    if v and None not in v:
                        x = np.array(v, dtype=np.float64)
                        top = np.abs(x).max()
                        x = x / top if np.isfinite(top) and top > 0 else None
                    if x is None:
                        keys.append(None), dims.append(None), units.append(None)
                    else:
                        u = (x / math.sqrt(float(x @ x))).astype("<f8").tobytes()
                        keys.append(hashlib.md5(u).hexdigest()), dims.append(len(x)), units.append(u)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.string()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "k", "dims", "unit"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "vec_id long, k string, dims int, unit binary")


def principal_axes(units: DataFrame, dims: int) -> np.ndarray:
    """Columns are the axes, by falling second moment; partitions sum outer products of fixed size."""

    def sums(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            for u in b.column(0).to_pylist():
                x = np.frombuffer(u, "<f8")
                total[: len(x), : len(x)] += np.outer(x, x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(table):
        return pa.table({"i": table.column("i")[:1], "row": pa.array([np.sum(np.array(table.column("row").to_pylist()), axis=0)], pa.list_(pa.float64()))})

    rows = units.select("unit").mapInArrow(sums, "i int, row array<double>").groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    moments = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def _merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Tie the trees of u[i] and v[i]; labels point at roots before and after."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def compare_tiles(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, same: bool):
    """Links of rows of ``a`` with rows of ``b`` (of ``a`` itself if ``same``): counts for either, weighted, and labels over both."""
    dims = a.shape[1]
    lead, more = min(LEAD, dims), min(NEXT, dims)
    tail = lambda x, k: np.sqrt(np.maximum(0.0, (x[:, k:] ** 2).sum(axis=1)))
    fa = np.column_stack([a[:, :lead], tail(a, lead)]).astype(np.float32)
    fb = fa if same else np.column_stack([b[:, :lead], tail(b, lead)]).astype(np.float32)
    ta, tb = tail(a, more), tail(b, more)
    links_a, links_b = np.zeros(len(a)), np.zeros(len(b))
    labels, shift = np.arange(len(a) + (0 if same else len(b))), 0 if same else len(a)
    for i0 in range(0, len(a), STEP):
        for j0 in range(i0 if same else 0, len(b), STEP):
            bound = fa[i0 : i0 + STEP] @ fb[j0 : j0 + STEP].T
            i, j = np.nonzero(bound >= threshold - SLACK)
            if same and i0 == j0:
                up = i < j
                i, j = i[up], j[up]
            if not len(i):
                continue
            if len(i) > bound.size // 16:  # dense: products of the whole block
                x, y = a[i0 : i0 + STEP], b[j0 : j0 + STEP]
                whole = x[:, :more] @ y[:, :more].T + x[:, more:] @ y[:, more:].T
                linked = whole[i, j] >= threshold
            else:
                linked = np.zeros(len(i), bool)
                for s in range(0, len(i), 100_000):
                    p, q = i[s : s + 100_000] + i0, j[s : s + 100_000] + j0
                    dot = np.einsum("ij,ij->i", a[p, :more], b[q, :more])
                    live = np.flatnonzero(dot + ta[p] * tb[q] >= threshold - 1e-12)
                    dot = dot[live] + np.einsum("ij,ij->i", a[p[live], more:], b[q[live], more:])
                    linked[s + live[dot >= threshold]] = True
            i, j = i[linked] + i0, j[linked] + j0
            links_a += np.bincount(i, weights=nb[j], minlength=len(a))
            links_b += np.bincount(j, weights=na[i], minlength=len(b))
            labels = _merge(labels, i, j + shift)
    return links_a, links_b, labels


def linked_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per input row.

    n_links counts the other rows with a cosine of at least ``threshold``.  A vector that is
    null, empty, zero or holds null or non-finite components has no links and is its own
    component.  Vectors of different lengths don't link.  Repeated rows link with each
    other as any equal vectors do.  A null id is never a component id but of its own.  An
    empty table gives an empty table; further columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    base = materialize(_units(vectors, id_col, vec_col), "units")
    valid = base.where("unit is not null")
    reps = materialize(valid.groupBy("k", "dims").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("unit").alias("unit")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    size = reps.agg(F.max("dims").alias("dims"), F.count("*").alias("n")).first()
    dims, n = size["dims"] or 1, size["n"]
    axes = principal_axes(reps, dims) if n else np.eye(1)
    r = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    depth = min(dims, 6, max(1, round(math.log(max(1, n / tile)) / math.log(3))))  # about a tile in each cell

    def rotate(batches):
        for b in batches:
            x = np.zeros((b.num_rows, dims))
            for row, u in enumerate(b.column(2).to_pylist()):
                y = np.frombuffer(u, "<f8")
                x[row, : len(y)] = y
            y = x @ axes
            cells = np.floor(y[:, :depth] / r).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(list(cells), pa.list_(pa.int32())), pa.array([v.tobytes() for v in y.astype("<f8")], pa.binary())], names=["node", "n", "dims", "cell", "y"])

    rotated = materialize(reps.select("node", "n", "unit", "dims").mapInArrow(rotate, "node long, n long, dims int, cell array<int>, y binary"), "rotated")
    cells = materialize(rotated.groupBy("dims", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("m")), "cells")
    steps = [s for s in itertools.product((-1, 0, 1), repeat=depth) if s >= (0,) * depth]  # each unordered pair of cells once
    near = cells.withColumn("step", F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])))
    near = near.select("dims", "cell", "m", F.zip_with("cell", F.col("step").cast("array<int>"), lambda c, s: (c + s).cast("int")).alias("cell_b"))
    met = near.join(cells.select("dims", F.col("cell").alias("cell_b"), F.col("m").alias("m_b")), ["dims", "cell_b"])
    pairs = (
        met.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .withColumn("sub_b", F.explode(F.sequence(F.lit(0), F.col("m_b") - 1)))
        .where((F.col("cell") != F.col("cell_b")) | (F.col("sub") <= F.col("sub_b")))
        .withColumn("same", (F.col("cell") == F.col("cell_b")) & (F.col("sub") == F.col("sub_b")))
        .withColumn("pair", F.concat_ws("|", "dims", F.concat_ws(",", F.col("cell").cast("array<string>")), "sub", F.concat_ws(",", F.col("cell_b").cast("array<string>")), "sub_b"))
    )
    sides = materialize(
        pairs.select("pair", "same", "dims", "cell", "sub", F.lit(0).alias("side")).unionByName(pairs.where(~F.col("same")).select("pair", "same", "dims", F.col("cell_b").alias("cell"), F.col("sub_b").alias("sub"), F.lit(1).alias("side"))),
        "pairs",
    )
    dealt = rotated.join(cells, ["dims", "cell"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).drop("m").join(sides, ["dims", "cell", "sub"]).select("pair", "same", "side", "node", "n", "y")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, count = table.column("node").to_numpy(), table.column("n").to_numpy()
        y = np.frombuffer(b"".join(table.column("y").to_pylist()), "<f8").reshape(table.num_rows, -1)
        same = table.column("same")[0].as_py()
        at = [np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))]
        la, lb, labels = compare_tiles(y[at[0]], y[at[1]], count[at[0]], count[at[1]], threshold, same)
        nodes = node[at[0]] if same else np.concatenate([node[at[0]], node[at[1]]])
        links = la + lb if same else np.concatenate([la, lb])
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        has = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array(np.concatenate([nodes[has], nodes[tied]])),
                "b": pa.array(np.concatenate([nodes[has], nodes[labels[tied]]])),
                "links": pa.array(np.concatenate([links[has], np.zeros(len(tied))]).astype(np.int64)),
            }
        )

    found = materialize(dealt.groupBy("pair").applyInArrow(compare, "a long, b long, links long"), "tile-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a <> b").select("a", "b"))
    named = reps.select("k", "node", "least", "n").join(links, "node", "left").join(roots, "node", "left").select("k", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(least, "root").select("k", (F.col("links") + F.col("n") - 1).alias("links"), "component")
    out = base.select("vec_id", "k").join(classes, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
