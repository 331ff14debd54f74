"""Token files of directly addressable codes.

A file image holds the ids of a run of whole documents.  An id is split into chunks of
eight bits; level k holds the k-th chunk of all ids that have one, a continuation bitmap
says which of them go on to level k + 1, and a rank directory counts the bitmap's ones
before every 512 bits.  Any id is read by one step per level, without decoding others:
its place at the next level is the rank of its continuation bit.

Images are written through Spark (its commit protocol, any file system), one per row of a
Parquet table, in ascending (part, piece) order of documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wayline.llm.tokens import encoder, steps
from wayline.plans.storage import new_table_path

MAGIC = b"DACF\x01\0\0\0"
BLOCK = 512  # bits of a bitmap per entry of its rank directory
#: An image is closed by the document that reaches this many ids.
IMAGE_TOKENS = 1 << 20

FILE_SCHEMA = "part int, piece int, n_docs long, n_tokens long, image binary"


def write_image(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """doc_ids: longs or None; ids: unsigned 32-bit arrays, one per document."""
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    levels = []
    while True:
        rest = flat >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(more, dtype=np.int64)))[:-1:BLOCK] if len(flat) else np.zeros(0, np.int64)
        levels.append((flat & 255).astype(np.uint8).tobytes() + bits.tobytes() + ones.astype("<u4").tobytes())
        levels[-1] = struct.pack("<Q", len(flat)) + levels[-1]
        if not more.any():
            break
        flat = rest[more]
    return b"".join([MAGIC, struct.pack("<QQ", len(doc_ids), len(levels)), known.tobytes(), numbers.tobytes(), ends.astype("<i8").tobytes(), *levels])


class TokenImage:
    """Reader of one image; ``image[i]`` is the i-th id."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        view, at = memoryview(data), 24
        docs, levels = struct.unpack_from("<QQ", data, 8)

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, dtype, n, at)
            at += out.nbytes
            return out

        known, numbers = take("u1", docs), take("<i8", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known)]
        self.ends = take("<i8", docs)
        self.levels = []
        for _ in range(levels):
            n = struct.unpack_from("<Q", data, at)[0]
            at += 8
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK))))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            part = bits[block * BLOCK // 8 : (i >> 3) + 1].copy()
            part[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(part).sum())
        raise ValueError("broken token file: a last level goes on")

    def all(self) -> np.ndarray:
        """All ids at once."""
        value = None
        for chunks, bits, _ in reversed(self.levels):
            level = chunks.astype(np.uint32)
            if value is not None:
                on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                level[on] |= value << 8
            value = level
        return value


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write their ids in ascending doc_id order; returns the table of images.

    Documents are dealt by ranges of (doc_id, hash of the text), so repeated ids have a
    place too (null ids come first).  A null text is empty and holds the end id alone.  A
    document is never cut: one that exceeds IMAGE_TOKENS has an image of its own.  An
    empty table writes no image.  Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or new_table_path(spark, "token-files")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        lib, part, piece, names, ids, n = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, [], [], 0

        def image():
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "image": pa.array([write_image(names, ids)], pa.binary())}
            )

        for b in steps(batches, 1):
            for d, x in zip(b.column(0).to_pylist(), lib.encode(b.column(1))):
                names.append(d)
                ids.append(np.frombuffer(x + end, dtype="<u4"))
                n += len(ids[-1])
                if n >= IMAGE_TOKENS:
                    yield image()
                    piece, names, ids, n = piece + 1, [], [], 0
        if names:
            yield image()

    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(path)
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def image_starts(files: DataFrame) -> DataFrame:
    """(part, piece, image_start): ids before each image, from counts per part, then within a part."""
    counts = files.select("part", "piece", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per written part
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(parts, "part").select("part", "piece", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("image_start"))


def read_token_files(files: DataFrame) -> DataFrame:
    """part, piece, doc_id, at (ids before it in its image), n_tokens and ids (binary) of every document in the images."""

    def run(batches):
        for b in batches:
            for part, piece, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                image = TokenImage(data)
                flat = image.all().astype("<u4")
                ends = image.ends.tolist()
                starts = [0, *ends[:-1]]
                for k in range(0, len(ends), 2000):
                    s, e = starts[k : k + 2000], ends[k : k + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(s), pa.int32()), pa.array([piece] * len(s), pa.int32()), pa.array(image.doc_ids[k : k + 2000], pa.int64()), pa.array(s, pa.int64()), pa.array([y - x for x, y in zip(s, e)], pa.int64()), pa.array([flat[x:y].tobytes() for x, y in zip(s, e)], pa.binary())],
                        names=["part", "piece", "doc_id", "at", "n_tokens", "ids"],
                    )

    return files.select("part", "piece", "image").mapInArrow(run, "part int, piece int, doc_id long, at long, n_tokens long, ids binary")


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of :func:`read_token_files` (best without ids, as they are dealt by image) with start, the ids of all documents before each."""
    return rows.join(image_starts(files), ["part", "piece"]).withColumn("start", F.col("image_start") + F.col("at")).drop("image_start")


def pick_tokens(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: (part, piece, at).  Adds the id at each place (null beyond the end), by rank steps alone."""

    def run(key, left, right):
        data = left.column("image")
        image = TokenImage(data[0].as_py()) if len(data) else None
        at = right.column("at").to_pylist()
        got = [image[i] if image is not None and i is not None and 0 <= i < len(image) else None for i in at]
        return pa.table({"part": right.column("part"), "piece": right.column("piece"), "at": right.column("at"), "id": pa.array(got, pa.int64())})

    return files.groupBy("part", "piece").cogroup(wanted.select("part", "piece", "at").groupBy("part", "piece")).applyInArrow(run, "part int, piece int, at long, id long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    back = read_token_files(files).select("part", "piece", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(back, files).select("doc_id", "start", "n_tokens", "ids_crc32")
