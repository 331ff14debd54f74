"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the text alone.
Every partition sums its part of the normal equations, which are added up and solved (their
size is fixed by the number of features).  Scores are then calibrated on labelled rows that
took no part in the fit: a monotone step function over score bins, by pooling violators.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.plans.storage import materialize

FEATURES = 128
RIDGE = 1e-3
SEED = 20240607
#: Bins of the raw score, between -0.5 and 1.5.
BINS = 1000

STATS = [
    "log_words", "word_length", "word_length_sd", "log_longest", "short_words", "distinct_words", "top_word", "distinct_triples", "same_neighbours",
    "upper", "digits", "symbols", "marks", "shouts", "stops", "high_bytes", "entropy", "distinct_lines", "log_line",
]
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 mark, 6 high byte, 7 white space
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[list(b"#*$%&|<>")], _CLASS[list(b".,;:?!'\"()-")], _CLASS[list(b" \t\n\r\x0b\x0c")] = 4, 5, 7


def text_stats(text: str | None) -> list[float]:
    """The statistics of one whole text, all finite; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=counts, minlength=8)
    seen = by.sum() - by[7]
    lengths = np.fromiter(map(len, words), np.int64, n)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    m = len(known)
    triples = (ids[:-2] * m + ids[1:-1]) * m + ids[2:] if n > 2 else ids
    share = counts[counts > 0] / counts.sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1.0, by[1] + by[2])
    return [
        np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), float((lengths <= 3).mean()), m / n, float(np.bincount(ids).max() / n), len(np.unique(triples)) / len(triples),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        by[1] / letters, by[3] / seen, by[4] / n, by[5] / n, counts[33] / n, counts[46] / n, by[6] / seen, float(-(share * np.log2(share)).sum()), len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)),
    ]


def _stats_of(texts) -> np.ndarray:
    return np.array([text_stats(t.as_py()) for t in texts], dtype=np.float64).reshape(-1, len(STATS))


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each row's whole text (null: empty)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x = _stats_of(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


def fold(id_col: str | Column = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has fold -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1))


@dataclasses.dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = x.shape[1]
        w, b = rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.values) if len(x) else np.zeros(0)


def pool_violators(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to ``means`` in order, by weighted least squares."""
    blocks: list[list[float]] = []
    for m, w in zip(means, weights):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, held_out: int = 2, calibrate: int = 3, folds: int = 4, label_col: str = "quality") -> Model:
    """Fit on labelled rows of all folds but ``held_out``; fold ``calibrate`` calibrates.

    Labels that are null go; a document with several labels counts once for each.  Without
    labelled rows all scores are 0.5; with one class only, the scores are that class.
    """
    both = [F.avg(F.col(s)).alias(f"m_{s}") for s in STATS] + [F.stddev_pop(F.col(s)).alias(f"s_{s}") for s in STATS]
    row = stats.agg(*both).first()
    mean = np.array([row[f"m_{s}"] or 0.0 for s in STATS])
    scale = np.array([row[f"s_{s}"] or 1.0 for s in STATS])
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.array([-0.5, 1.5]), np.array([0.5, 0.5]))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    rows = materialize(stats.join(known, "doc_id").withColumn("fold", fold(folds=folds)).where(F.col("fold") != held_out).select("fold", "y", *STATS), "labelled")

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 1 + len(STATS))])
            z = model.features(x)
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ b.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(table):
        return pa.table({"i": table.column("i")[:1], "row": pa.array([np.sum(np.array(table.column("row").to_pylist()), axis=0)], pa.list_(pa.float64()))})

    parts = rows.where(F.col("fold") != calibrate).select("y", *STATS).mapInArrow(sums, "i int, row array<double>")
    summed = np.array([r["row"] for r in sorted(parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect(), key=lambda r: r["i"])])  # of fixed size
    if summed.size and (n := summed[-1, -2]) > 0:
        ridge = RIDGE * n * np.eye(FEATURES + 1)
        ridge[-1, -1] = 0
        model.weights = np.linalg.solve(summed[:, :-1] + ridge + 1e-9 * np.eye(FEATURES + 1), summed[:, -1])
    else:
        return model

    def binned(batches):
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 1 + len(STATS))])
            at = np.minimum((model.raw(x) + 0.5) / 2 * BINS, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0)], names=["bin", "y"])

    bins = rows.where(F.col("fold") == calibrate).select("y", *STATS).mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    if bins:
        model.edges = (np.array([b["bin"] for b in bins]) + 0.5) / BINS * 2 - 0.5
        model.values = np.clip(pool_violators(np.array([b["y"] for b in bins]), np.array([b["n"] for b in bins])), 0, 1)
    else:
        model.values = np.array([0.0, 1.0])
        model.edges = np.array([0.0, 1.0])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; texts are read once.

    A null or empty text has zero statistics and is scored as any other; a null id is in no
    fold; repeated rows have equal scores; an empty table gives an empty table.
    """
    stats = materialize(document_stats(docs), "stats")
    model = fit(stats, labels, held_out, folds=folds)

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 1 + len(STATS))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = stats.select("doc_id", *STATS).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(folds=folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, folds: int = 4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with their columns: fitted, then filtered as they are read."""
    model = fit(materialize(document_stats(docs, text_col=text_col), "stats"), labels, held_out, folds=folds)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(_stats_of(b.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
