"""Mixture-controlled packing: deficit round-robin over source queues into full windows.

Each source queues the tokens of its documents.  While windows fill, a source's deficit
grows by its target share of every token packed, and the source is served one turn of
``turn`` tokens whenever its deficit reaches a turn's length; what it is short of or ahead
stays for the next window.  The k-th turn of a source is thus due when k * turn / share
tokens have been packed, which gives every turn its place without a sequential pass:
turns are sorted by that time over the cluster, a running sum gives each its position, and
windows are cut every ``window`` tokens.  A queue that is empty drops out; the others'
turns close up.  Only the last window can have padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.plans.running import running_sum
from wayline.llm.tokens import encode_texts, vocabulary_size
from wayline.plans.storage import materialize

WINDOW = 4096
#: Tokens of a turn: the most by which a source runs ahead of or behind its share.
TURN = 256
_NO_SOURCE = "\x00"


def shares(queues: DataFrame, weights: DataFrame | None = None, temperature: float = 1.0) -> DataFrame:
    """(queue, tokens, share) of each source queue.

    Without ``weights`` (source, weight) a share is its tokens to the power ``temperature``:
    1 gives every window the proportions of the whole, so that all queues end together.
    A source without a positive weight has the least positive share of the others.
    """
    sums = queues.groupBy("queue").agg(F.sum("n_tokens").alias("tokens"))
    if weights is None:
        return sums.withColumn("share", F.pow(F.col("tokens").cast("double"), F.lit(float(temperature))))
    given = weights.select(F.coalesce(F.col("source").cast("string"), F.lit(_NO_SOURCE)).alias("queue"), F.col("weight").cast("double").alias("w")).where("w > 0").groupBy("queue").agg(F.sum("w").alias("w"))
    least = given.agg(F.min("w").alias("least"))
    return sums.join(given, "queue", "left").join(F.broadcast(least)).select("queue", "tokens", F.coalesce("w", "least", F.lit(1.0)).alias("share"))


def plan_pieces(lengths: DataFrame, window: int = WINDOW, turn: int = TURN, weights: DataFrame | None = None, temperature: float = 1.0) -> DataFrame:
    """``lengths``: (uid, doc_id, queue, n_tokens).  Returns (uid, start, length, sequence_id, offset) of every piece."""
    queued = running_sum(lengths, ["queue", "doc_id", "uid"], "n_tokens", within="queue", out="at")
    due = queued.join(shares(lengths, weights, temperature), "queue")
    end = F.col("at") + F.col("n_tokens")
    turns = due.where("n_tokens > 0").withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / turn), F.floor((end - 1) / turn))))
    low, high = F.greatest("at", F.col("k") * turn), F.least(F.col("at") + F.col("n_tokens"), (F.col("k") + 1) * turn)
    pieces = turns.select(
        "uid",
        (F.least((F.col("k") + 1) * turn, F.col("tokens")) / F.col("share")).alias("due"),
        F.xxhash64("queue").alias("q"),
        "queue",
        low.alias("place"),
        (low - F.col("at")).alias("start"),
        (high - low).alias("length"),
    )
    placed = running_sum(pieces, ["due", "q", "queue", "place"], "length", out="pos")
    w = F.floor(F.col("pos") / window)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(w, F.floor((F.col("pos") + F.col("length") - 1) / window))))
    low, high = F.greatest("pos", F.col("sequence_id") * window), F.least(F.col("pos") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return cut.select("uid", (F.col("start") + low - F.col("pos")).alias("start"), (high - low).alias("length"), "sequence_id", (low - F.col("sequence_id") * window).alias("offset"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    window: int = WINDOW,
    turn: int = TURN,
    weights: DataFrame | None = None,
    temperature: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row per piece: doc_id, source, start, length, doc_tokens, sequence_id, offset and ids (binary, little-endian unsigned 32-bit).

    A null text is empty and holds the end id alone; null sources form one queue; documents
    of a queue go in order of id (null ids first), repeated rows one after the other; an
    empty table gives no pieces; further columns are ignored.
    """
    if not 0 < turn <= window:
        raise ValueError("a turn has 1 to window tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    narrow = vocabulary_size(tokenizer_path) <= 65536
    width = 2 if narrow else 4
    tokens = materialize(encode_texts(rows, tokenizer_path, end_id, "text", ("uid", "doc_id", "source"), narrow), "tokens")
    lengths = tokens.select("uid", "doc_id", F.coalesce("source", F.lit(_NO_SOURCE)).alias("queue"), "n_tokens")
    pieces = plan_pieces(lengths, window, turn, weights, temperature).groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    both = tokens.join(pieces, "uid").select("doc_id", "source", "n_tokens", "ids", F.col("pieces.start").alias("s"), F.col("pieces.length").alias("l"), F.col("pieces.sequence_id").alias("w"), F.col("pieces.offset").alias("o"))

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                b = whole.slice(first, 200)
                counts = pa.compute.list_value_length(b.column(4)).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(b.num_rows), counts)
                flat = [pa.compute.list_flatten(b.column(k)) for k in (4, 5, 6, 7)]
                ids = b.column(3).to_pylist()
                cut = [ids[d][width * s : width * (s + n)] for d, s, n in zip(owner.tolist(), flat[0].to_pylist(), flat[1].to_pylist())]
                if narrow:
                    cut = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in cut]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), flat[0], flat[1], b.column(2).take(take), flat[2], flat[3], pa.array(cut, pa.binary())],
                    names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return both.mapInArrow(run, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))
