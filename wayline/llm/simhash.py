"""SimHash near-duplicates: fingerprints, a grid over segment bit counts, exact verification.

A 64-bit fingerprint becomes a point of 32 coordinates, the bit counts of its two-bit
segments.  One flipped bit moves one coordinate by one, so the Manhattan distance of two
points never exceeds the Hamming distance of their fingerprints.  If that distance is at
most 3, then one half of the 16 + 16 coordinates differs by at most 1.  Each half is thus
a grid whose cells are the exact coordinates: a point is dealt to its own cell and looks
into the cells within distance 1 of it (at most 33, some 25 on average).  Pairs that meet
are filtered by the Manhattan distance over all coordinates, then by Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wayline.llm.components import connected_components
from wayline.plans.storage import materialize

HALF = 16  # coordinates of a half
CELLS = 3**HALF
_LOW_BITS = 0x5555555555555555
_LOW_HALF = 0x55555555


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The fingerprint as an unsigned 64-bit number; 0 without any word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        hashes = [xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts[: n - shingle_words + 1].tolist(), (ends[shingle_words - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits in a signed long.  A null or wordless text has fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle_words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cells(fps: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fps.astype("<i8").view(np.uint8), bitorder="little").reshape(len(fps), 64)
    return bits.reshape(len(fps), 32, 2).sum(axis=2, dtype=np.int64)


_POWERS = 3 ** np.arange(HALF, dtype=np.int64)


def _looks(batches):
    """(cell, fp) for the cells within Manhattan distance 1, of either half."""
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            counts = _cells(part)
            cells, owners = [], []
            for half in (0, 1):
                c = counts[:, half * HALF : (half + 1) * HALF]
                own = c @ _POWERS + half * CELLS
                cells.append(own)
                owners.append(part)
                for step, room in ((1, c < 2), (-1, c > 0)):
                    row, dim = np.nonzero(room)
                    cells.append(own[row] + step * _POWERS[dim])
                    owners.append(part[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(owners))], names=["cell", "fa"])


def _homes(batches):
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        counts = _cells(fps)
        cells = [counts[:, h * HALF : (h + 1) * HALF] @ _POWERS + h * CELLS for h in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate([fps, fps]))], names=["cell", "fb"])


def near_fingerprints(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in 1 to ``distance`` (at most 3) bits.

    ``fps``: one column of distinct longs.
    """
    if not 1 <= distance <= 3:
        raise ValueError("two halves within distance 1 cover distances up to 3")
    looks = fps.mapInArrow(_looks, "cell long, fa long")
    homes = fps.mapInArrow(_homes, "cell long, fb long")
    low, half = F.lit(_LOW_BITS), F.lit(_LOW_HALF)
    met = looks.join(homes, "cell").where("fa < fb")
    some = lambda c: F.col(c).bitwiseOR(F.shiftrightunsigned(c, 1)).bitwiseAND(low)  # noqa: E731  segments with a bit
    full = lambda c: F.col(c).bitwiseAND(F.shiftrightunsigned(c, 1)).bitwiseAND(low)  # noqa: E731  segments with both
    s, f = some("fa").bitwiseXOR(some("fb")), full("fa").bitwiseXOR(full("fb"))
    first_half = F.bit_count(s.bitwiseAND(half)) + F.bit_count(f.bitwiseAND(half))
    return (
        met.where(F.bit_count(s) + F.bit_count(f) <= distance)
        .where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance)
        .where((F.col("cell") < CELLS) | (first_half > 1))  # a pair that meets in both halves counts in the first
        .select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    )


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), a row per input row.

    component_id is the smallest id reachable over fingerprints that differ in at most
    ``distance`` bits.  Equal fingerprints are folded to one before any comparison, so a
    group of copies costs one row whatever its size.  Null and wordless texts share
    fingerprint 0 and are linked like others; a null id never becomes a component id
    (a component of null ids alone has a null id); repeated rows stay; an empty table
    gives an empty table; further columns of ``docs`` are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = materialize(connected_components(near_fingerprints(classes.select("fp"), distance)), "roots")
    tied = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    named = tied.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
