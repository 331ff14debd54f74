"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A text becomes words of lower-case letters with marks at their ends; the counts of their
hashed 1- to 4-grams weigh the rows of an embedding table, and a softmax reads the average.
Both are trained by stochastic gradient descent in numpy on a bounded sample of each
language: shards of the sample descend side by side from shared parameters, which are
averaged after every round.  A part of the sample takes no part in this: it sets the
temperature of the scores and the score below which a text's language counts as unknown.
"""

from __future__ import annotations

import dataclasses
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.plans.storage import load_table, materialize

ORDERS = (1, 2, 3, 4)
BITS = 15
DIMS = 16
#: Rows of each language in the sample, expected at most.
PER_LANGUAGE = 1000
#: One part in this many of the sample calibrates instead of training.
CALIBRATE = 8
#: Rows of a shard, about, and shards at most.
SHARD_ROWS, SHARDS = 500, 16
#: Rounds of averaging, and steps over the sample in all (as many epochs as that takes).
ROUNDS, STEPS, EPOCHS = 4, 40_000, 60
RATE = 0.5
#: Accepted texts of the calibrating rows are right in this share at least.
RIGHT = 0.99
#: The model has a row per language; a column with more distinct values isn't one of languages.
MAX_LANGUAGES = 10_000
UNKNOWN = "und"
#: Characters of a text that are handled at a time.
STEP = 1 << 20
TEMPERATURES = np.geomspace(0.5, 20, 41)  # never much sharper than the softmax itself, however few rows calibrate
BINS = 1000

_TABLES: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or combining mark (0: neither), and whether it is a letter."""
    if not _TABLES:
        lower, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(ch := chr(c))
            if kind[0] in "LM":
                letter[c] = kind[0] == "L"
                lower[c] = ord(low) if len(low := ch.lower()) == 1 else ord(low[0])
        _TABLES.extend((lower, letter))
    return _TABLES[0], _TABLES[1]


def subword_counts(text: str | None) -> tuple[np.ndarray, bool]:
    """Counts by bucket of a whole text's subwords, and whether it holds a letter."""
    lower, letter = _letters()
    size = 1 << BITS
    counts, found = np.zeros(size + 1, np.int64), False
    text = unicodedata.normalize("NFC", text or "")
    carry = np.zeros(1, np.uint32)  # the word gap ahead of the text
    for start in range(0, len(text), STEP):
        codes = np.frombuffer(text[start : start + STEP].encode("utf-32-le", "surrogatepass"), "<u4")
        found = found or bool(letter[codes].any())
        x = lower[codes]
        solid = x != 0
        x = x[solid | np.concatenate(([carry[-1] != 0], solid[:-1]))]  # a run of other characters is one gap
        if start + STEP >= len(text) and (x[-1] if len(x) else carry[-1]) != 0:
            x = np.append(x, np.uint32(0))
        y = np.concatenate([carry, x])
        for n in ORDERS:
            part = y[max(0, len(carry) - n + 1) :]  # grams that end in the new part
            if len(part) < n:
                continue
            m = len(part) - n + 1
            h = np.full(m, 2166136261 + n, np.uint32)
            whole = np.ones(m, bool)
            for k in range(n):
                h = (h ^ part[k : k + m]) * np.uint32(16777619)
                if n == 1 or 0 < k < n - 1:
                    whole &= part[k : k + m] != 0  # gaps stand at the ends only
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435769)
            counts += np.bincount(np.where(whole, h >> np.uint32(32 - BITS), size), minlength=size + 1)
        carry = y[-(max(ORDERS) - 1) :]
    return counts[:size], found


def fold(id_col: str | Column = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclasses.dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: the embeddings times the softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def logits(self, counts: np.ndarray) -> np.ndarray:
        norm = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        return (counts @ self.table) / np.maximum(norm, 1.0) + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(counts) / self.temperature)


def descend(embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]], rates: np.ndarray, seed: int) -> None:
    """One epoch after another over ``rows`` (buckets, weights, class), at a step's rate from ``rates``; changes the parameters in place."""
    rng = np.random.default_rng(seed)
    step = 0
    for _ in range(len(rates) // max(1, len(rows))):
        for r in rng.permutation(len(rows)):
            at, f, y = rows[r]
            mine = embeddings[at]
            hidden = f @ mine
            z = hidden @ weights + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            g *= rates[step]
            back = weights @ g
            weights -= np.outer(hidden, g)
            bias -= g
            embeddings[at] = mine - np.outer(f, back)
            step += 1


def _pairs(counts: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(counts).astype("<u2")
    return at.tobytes(), counts[at].astype("<i4").tobytes()


def _dense(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    out = np.zeros((table.num_rows, 1 << BITS), np.float32)
    for r, (at, n) in enumerate(zip(table.column("at").to_pylist(), table.column("n").to_pylist())):
        out[r, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<i4")
    return out


def sample_features(docs: DataFrame, held_out: int, folds: int, per_language: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], DataFrame]:
    """The languages in order, and (u, y, at, n) of the sample: a key, the language's number, and the counts of each text's buckets."""
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where((fold("id", folds) != held_out) & F.col("lang").isNotNull() & F.col("t").isNotNull())
    rows = known.groupBy("lang").agg(F.count("*").alias("rows")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    languages = sorted(r["lang"] for r in rows)
    number = {lang: i for i, lang in enumerate(languages)}
    shares = spark.createDataFrame([(r["lang"], number[r["lang"]], int(min(1.0, per_language / r["rows"]) * (1 << 31))) for r in rows], "lang string, y int, below long")
    drawn = known.join(F.broadcast(shares), "lang").withColumn("u", F.xxhash64("id", "t")).where(F.pmod(F.shiftrightunsigned("u", 3), F.lit(1 << 31)) < F.col("below"))

    def run(batches):
        for b in batches:
            keep, ats, ns = [], [], []
            for i, t in enumerate(b.column(2)):
                counts, found = subword_counts(t.as_py())
                if found:
                    at, n = _pairs(counts)
                    keep.append(i), ats.append(at), ns.append(n)
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ats, pa.binary()), pa.array(ns, pa.binary())], names=["u", "y", "at", "n"])

    features = drawn.select("u", "y", "t").mapInArrow(run, "u long, y int, at binary, n binary")
    return languages, features.dropDuplicates(["u", "y"])  # repeated rows count once, so the sample stays as small as promised


def train(docs: DataFrame, held_out: int = 2, folds: int = 4, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages named in ``lang_col``, from rows outside fold ``held_out`` alone.

    Rows with a null id, text or language, and texts without letters, teach nothing.  The
    sample holds ``per_language`` rows of each language, expected at most, drawn by a hash
    of id and text; a language with few rows is learned from these.  Without any row the
    model has no languages.
    """
    languages, sample = sample_features(docs, held_out, folds, per_language, id_col, text_col, lang_col)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    sample = materialize(sample, "sample")
    calibrating = F.pmod("u", F.lit(CALIBRATE)) == 0
    size = sample.where(~calibrating).count()
    shards = max(1, min(SHARDS, round(size / SHARD_ROWS)))
    epochs = max(1, min(EPOCHS, round(STEPS / max(1, size))) // ROUNDS)
    rng, k = np.random.default_rng(7), len(languages)
    embeddings, weights, bias = rng.normal(size=(1 << BITS, DIMS)) / np.sqrt(DIMS), np.zeros((DIMS, k)), np.zeros(k)
    shares = sample.where(~calibrating).withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int"))
    for turn in range(ROUNDS if size else 0):
        start = embeddings.astype(np.float32), weights, bias

        def shard(table):
            table = table.sort_by([("u", "ascending"), ("y", "ascending")])
            rows = []
            for at, n, y in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), table.column("y").to_pylist()):
                f = np.frombuffer(n, "<i4").astype(np.float64)
                rows.append((np.frombuffer(at, "<u2"), f / np.sqrt(f @ f), y))
            e, w, b = (x.astype(np.float64) for x in start)
            steps = len(rows) * epochs
            rates = RATE * (1 - (turn * steps + np.arange(steps)) / (ROUNDS * steps))
            descend(e, w, b, rows, rates, seed=turn)
            return pa.table({"rows": pa.array([len(rows)]), "e": pa.array([e.astype("<f4").tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()), "b": pa.array([b.tobytes()], pa.binary())})

        parts = shares.groupBy("shard").applyInArrow(shard, "rows long, e binary, w binary, b binary").collect()  # models of fixed size, one per shard
        total = sum(p["rows"] for p in parts)
        mean = lambda name, kind, like: sum(np.frombuffer(p[name], kind).astype(np.float64) * (p["rows"] / total) for p in parts).reshape(like.shape)
        embeddings, weights, bias = mean("e", "<f4", embeddings), mean("w", "<f8", weights), mean("b", "<f8", bias)
    model = Model(languages, (embeddings @ weights).astype(np.float32), bias)
    return calibrated(model, sample.where(calibrating))


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with the temperature of least log loss on ``rows``, and the lowest score whose accepted rows are right often enough."""

    def batched(batches, step=256):
        for b in batches:
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                yield model.logits(_dense(part)), part.column("y").to_numpy(zero_copy_only=False)

    def losses(batches):
        total, n = np.zeros(len(TEMPERATURES)), 0
        for z, y in batched(batches):
            for i, t in enumerate(TEMPERATURES):
                total[i] -= np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-300)).sum()
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "loss", "n"])

    found = rows.select("y", "at", "n").mapInArrow(losses, "i int, loss double, n long").groupBy("i").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()
    if not found or not found[0]["n"]:
        return model
    model = dataclasses.replace(model, temperature=float(TEMPERATURES[min(found, key=lambda r: (r["loss"], r["i"]))["i"]]))

    def outcomes(batches):
        seen, right = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for z, y in batched(batches):
            p = _softmax(z / model.temperature)
            at = np.minimum((p.max(axis=1) * BINS).astype(int), BINS - 1)
            seen += np.bincount(at, minlength=BINS)
            right += np.bincount(at[p.argmax(axis=1) == y], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(seen), pa.array(right)], names=["bin", "seen", "right"])

    bins = rows.select("y", "at", "n").mapInArrow(outcomes, "bin int, seen long, right long").groupBy("bin").agg(F.sum("seen").alias("seen"), F.sum("right").alias("right")).orderBy("bin").collect()
    seen, right = (np.cumsum([r[c] for r in bins][::-1])[::-1] for c in ("seen", "right"))  # at or above each bin
    enough = np.flatnonzero((right >= RIGHT * seen) & (seen > 0))
    return dataclasses.replace(model, least=float(enough[0]) / BINS if len(enough) else 1.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepted, a row per input row.

    lang_pred is the likeliest language (of ties the first in order) and score its
    calibrated probability; accepted tells whether the score suffices.  A text that is null
    or has no letter, and any text if the model knows no language, is ``und`` with score 0
    and isn't accepted.  Repeated rows get equal rows; an empty table gives an empty table;
    further columns are ignored.
    """
    languages = pa.array([*model.languages, UNKNOWN])

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                found = [subword_counts(t.as_py()) for t in part.column(1)]
                known = np.array([f for _, f in found], bool) & bool(model.languages)
                best, score = np.full(len(found), len(model.languages)), np.zeros(len(found))
                if known.any():
                    p = model.probabilities(np.array([c for (c, _), k in zip(found, known) if k], dtype=np.float32))
                    best[known], score[known] = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), languages.take(pa.array(best)), pa.array(score), pa.array(known & (score >= model.least))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang and score: the language, or ``und`` where the score doesn't suffice."""
    return predict(docs, model, id_col, text_col).select("doc_id", F.when(F.col("accepted"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang"), "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", (F.coalesce(fold(), F.lit(-1)) == 2).alias("held_out"), "lang_pred", "score", "accepted")
