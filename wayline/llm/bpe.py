"""Byte-level BPE by relational steps: DuckDB contracts and decodes the tokens of a partition.

Every Spark task cuts its texts into pre-tokens.  Those without known ids become rows
(word, position, token) of a DuckDB table; a recursive query joins adjacent tokens with
the merge table, and contracts in each word the leftmost pair of minimum rank until no
word has a pair left.  Decoding joins (run, position, id) rows with the vocabulary and
aggregates their bytes in order of position.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wayline.llm.tokens import SPACED_SPACE, Pieces, Recent, in_order, steps, whole_ids

#: Sum over a query's words of (bytes squared / 2), which bounds the rows of its recursion.
QUERY_ROWS = 3_000_000
#: Words of more bytes (unbroken runs of one character class) are contracted by the same rule with a heap:
#: one pair per recursion over all positions of such a word would be quadratic.
LONG_WORD = 400
DUCKDB_MEMORY = "200MB"
IDS = T.ArrayType(T.IntegerType())

#: The state of a word is the list of its tokens; its (position, token, next token) rows meet the merges in every step.
CONTRACT = """
WITH RECURSIVE s AS (
  SELECT word, toks FROM start_rows
  UNION ALL
  SELECT s.word, s.toks[:b.best % 1024 - 1] || [(b.best // 1024)::INTEGER] || s.toks[b.best % 1024 + 2:]
  FROM s JOIN (
    SELECT p.word, min(m.merged * 1024 + p.pos) AS best
    FROM (SELECT word, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS nxt, unnest(range(1, len(toks))) AS pos FROM s WHERE len(toks) > 1) p
    JOIN merges m ON m.pair = p.tok::BIGINT * 4294967296 + p.nxt
    GROUP BY p.word) b ON s.word = b.word
)
SELECT word, arg_min(toks, len(toks)) AS toks FROM s GROUP BY word ORDER BY word
"""
DECODE = """
SELECT run, string_agg(coalesce(piece, 'efbfbd'), '' ORDER BY pos) AS bytes
FROM id_rows LEFT JOIN vocabulary USING (id) GROUP BY run ORDER BY run
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RelationalBpe:
    """One per Python worker and vocabulary."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb

        ranks = read_ranks(ranks_path)
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = [(a * 4294967296 + b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "merged": pa.array([m for _, m in pairs], pa.int64())})
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "piece": pa.array([t.hex() for t in ranks])})
        self.db.register("m", merges)
        self.db.register("v", vocabulary)
        self.db.execute("CREATE TABLE merges AS FROM m")
        self.db.execute("CREATE TABLE vocabulary AS FROM v")
        self.merge_of = None
        self.opens = np.zeros(max(ranks.values()) + 2, dtype=bool)  # tokens with a space in front; the last place: unknown ids
        self.opens[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        self.first, self.rest, self.runs = Pieces(self._cut, self._cut), Pieces(lambda new: self._cut([" " + x for x in new]), self._cut), Recent(key=pa.large_binary())

    # -- encoding

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word, by the recursive query."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        toks = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        rows = pa.table({"word": np.arange(len(words)), "toks": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(toks))})
        self.db.register("start_rows", rows)
        got = self.db.sql(CONTRACT).to_arrow_table().column("toks").combine_chunks()
        self.db.unregister("start_rows")
        flat = got.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
        at = (np.concatenate(([0], np.cumsum(got.value_lengths().to_numpy(zero_copy_only=False)))) * 4).tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def _contract_long(self, word: bytes) -> bytes:
        """The same contraction of one long word: a heap of (rank, position) over linked positions."""
        if self.merge_of is None:
            self.merge_of = dict(self.db.execute("SELECT pair, merged FROM merges").fetchall())
        tok = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        pair = lambda i: self.merge_of.get(tok[i] * 4294967296 + tok[right[i]]) if right[i] < n else None
        heap = [(m, i) for i in range(n) if (m := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            if not live[i] or pair(i) != m:
                continue
            gone = right[i]
            tok[i], live[gone], right[i] = m, False, right[gone]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (m := pair(k)) is not None:
                    heapq.heappush(heap, (m, k))
        return np.array([t for t, on in zip(tok, live) if on], dtype="<i4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        todo = []
        for k, w in enumerate(words):
            b = w.encode()
            if (r := self.ranks.get(b)) is not None:  # a pre-token of the vocabulary is one token
                out[k] = r.to_bytes(4, "little")
            elif len(b) > LONG_WORD:
                out[k] = self._contract_long(b)
            else:
                todo.append((k, b))
        todo.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(todo):
            to, rows = at, 0
            while to < len(todo) and (to == at or rows < QUERY_ROWS):
                rows += len(todo[to][1]) ** 2 // 2
                to += 1
            for (k, _), ids in zip(todo[at:to], self._contract([b for _, b in todo[at:to]])):
                out[k] = ids
            at = to
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the pre-tokens that the pattern finds; a space and letters need no search."""
        cut = [[t] if t[:1] == " " and t[1:].isalpha() else self.pattern.findall(t) for t in texts]
        every = list(dict.fromkeys(itertools.chain.from_iterable(cut)))
        get = dict(zip(every, self._words(every))).__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text.  Cut before single spaces first: no pre-token spans those (see tokens.py)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        unsafe, out = pc.match_substring_regex(texts, SPACED_SPACE).to_numpy(zero_copy_only=False).astype(bool), [b""] * len(texts)
        for n, ids in zip(np.flatnonzero(unsafe).tolist(), self._cut(texts.filter(pa.array(unsafe)).to_pylist())):
            out[n] = ids
        if not unsafe.all():
            for n, ids in zip(np.flatnonzero(~unsafe).tolist(), whole_ids(texts.filter(pa.array(~unsafe)), True, self.first, self.rest)):
                out[n] = ids
        return out

    # -- decoding

    def _decode_runs(self, runs: list[bytes]) -> list[bytes]:
        out, at = [], 0
        while at < len(runs):
            to, n = at, 0
            while to < len(runs) and (to == at or n < QUERY_ROWS):
                n += len(runs[to]) // 4
                to += 1
            part = runs[at:to]
            lengths = np.fromiter((len(r) // 4 for r in part), np.int64, len(part))
            starts = np.cumsum(lengths) - lengths
            ids = np.frombuffer(b"".join(part), "<i4").astype(np.int64)
            self.db.register("id_rows", pa.table({"run": np.repeat(np.arange(len(part)), lengths), "pos": np.arange(len(ids)) - np.repeat(starts, lengths), "id": ids}))
            out += [bytes.fromhex(x) for x in self.db.sql(DECODE).to_arrow_table().column("bytes").to_pylist()]
            self.db.unregister("id_rows")
            at = to
        return out

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """Bytes of each row of ids; runs from one token with a space in front to the next are decoded once while they are recent."""
        data = b"".join(rows)
        if not data:
            return [b""] * len(rows)
        ids = np.frombuffer(data, "<i4")
        ends = np.cumsum([len(r) // 4 for r in rows])
        opens = self.opens[np.clip(ids, 0, len(self.opens) - 1)]
        opens[ends[:-1][ends[:-1] < len(ids)]] = opens[0] = True  # a row begins a run
        begin = np.flatnonzero(opens)
        runs = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(ids)) * 4), pa.py_buffer(data)])
        coded = runs.dictionary_encode()
        out_ends, out = in_order(self.runs.values(coded.dictionary, self._decode_runs).take(coded.indices))
        places = out_ends[np.searchsorted(begin, np.concatenate(([0], ends)))].tolist()
        return [bytes(out[a:b]) for a, b in zip(places, places[1:])]


_MODELS: dict[tuple[str, str], RelationalBpe] = {}


def _model(path: str, pattern: str) -> RelationalBpe:
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = RelationalBpe(path, pattern)
    return _MODELS[path, pattern]


def _lists(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def _rows(ids: pa.Array) -> list[bytes]:
    return [b"" if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes() for x in ids]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ids (array of int) of each row's whole text, as tiktoken's ``encode_ordinary``.

    A null text is empty and has no ids; equal rows have equal ids; other columns go.
    """
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    last = len(keep)

    def run(batches):
        model = _model(ranks_path, pattern)
        for b in steps(batches, last):
            yield pa.RecordBatch.from_arrays([*b.columns[:last], _lists(model.encode(pc.fill_null(b.column(last), "")))], names=[*keep, "ids"])

    return kept.mapInArrow(run, kept.drop("_text").schema.add("ids", IDS))


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and decoded (binary).  Null ids decode to no bytes; an id outside the vocabulary to U+FFFD."""
    kept = tokens.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))
    last = len(keep)

    def run(batches):
        model = _model(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(model.decode(_rows(part.column(last))), pa.binary())], names=[*keep, "decoded"])

    return kept.mapInArrow(run, kept.drop("_ids").schema.add("decoded", "binary"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids, in one pass of the same workers: ``keep`` columns, ids and decoded."""
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    last = len(keep)

    def run(batches):
        model = _model(ranks_path, pattern)
        for b in steps(batches, last):
            ids = model.encode(pc.fill_null(b.column(last), ""))
            yield pa.RecordBatch.from_arrays([*b.columns[:last], _lists(ids), pa.array(model.decode(ids), pa.binary())], names=[*keep, "ids", "decoded"])

    return kept.mapInArrow(run, kept.drop("_text").schema.add("ids", IDS).add("decoded", "binary"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
