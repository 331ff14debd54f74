"""Language-model scores: prediction by partial matching over bytes, and a word-count base.

The byte model reads a whole text as a stream of symbols: its lower-cased bytes and one end.
ORDER symbols in front of the text stand for its start.  Each symbol is predicted from the
last ORDER symbols; if that context has not been followed by it in training, an escape
leads to the context without its farthest symbol, and so on down to none and to an even
share of the symbols never met.  Escapes are estimated by method D (each distinct symbol
that can still occur gives up half a count); symbols of a longer context are excluded from
the shorter ones.

Whatever follows a context also follows its suffixes, so the symbols excluded at a context
are just those of the context one longer.  A symbol's probability thus depends on counts of
its context and suffixes alone, and each distinct string of ORDER + 1 symbols is scored
once.  Strings are numbers whose leading digits are the nearest symbols: sorted, they are
the leaves of the context trie.  They are counted over the cluster and dealt by the three
nearest symbols, so that a task holds every context of three symbols or more that it needs
(at most 257 ** 3 strings share three symbols); contexts of up to two symbols have at most
258 ** 2 * 257 counts together and are sent to all tasks.  The most frequent strings, a
fixed number, are scored from tables that all tasks hold; the others meet their scores in
a shuffle by the string's hash, in packed runs of many strings a row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.llm.quality_classifier import fold
from wayline.llm.tokens import steps
from wayline.plans.storage import materialize

#: Symbols of the longest contexts; 6 at most, as a string of order + 1 symbols is one 64-bit number.
ORDER = 5
BITS = 9
SYMBOLS = 257  # bytes and the end; the start is never predicted
END, START = 256, 257
#: The end of a text as an entry among the words; no word holds white space.
END_WORD = b"\n"
#: Most frequent words and strings of symbols that all tasks hold; the others are joined.
HOT_WORDS = 1 << 17
HOT_STRINGS = 1 << 20
#: Distinct words, and strings, that a task counts before it hands them on.
FLUSH = 150_000
FLUSH_STRINGS = 1_500_000
#: Text bytes that a task turns into strings at a time.
STEP = 2 << 20
#: Strings scored at once (whole contexts of three symbols), strings of a lookup bucket, and of a packed row.
BLOCK = 500_000
BUCKET = 250_000
LEAST_BUCKETS = 64
RUN = 4096


# -- symbols and strings


def symbol_rows(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one stream of symbols, each behind ``order`` starts, and where each begins (at its first start)."""
    lower = [(t or b"").lower() for t in texts]
    gap = bytes(order)
    x = np.frombuffer(gap + (b"\0" + gap).join(lower) + b"\0", np.uint8).astype(np.int64)
    size = np.fromiter(map(len, lower), np.int64, len(lower)) + order + 1
    begin = np.cumsum(size) - size
    x[begin + size - 1] = END
    x[(begin[:, None] + np.arange(order)).ravel()] = START
    return x, begin


def strings(x: np.ndarray, order: int) -> np.ndarray:
    """The string that ends at each symbol from the ``order``-th on: nearest symbol of the context first, the symbol itself last."""
    n = len(x) - order
    code = x[order - 1 : order - 1 + n] << BITS * order
    for j in range(2, order + 1):
        code |= x[order - j : order - j + n] << BITS * (order + 1 - j)
    code |= x[order:]
    return code


# -- words


def _words(text: bytes | None) -> Counter:
    """The lower-cased words of a text, and its end, with their counts."""
    c = Counter((text or b"").lower().split())
    c[END_WORD] = 1
    return c


def count_words(docs: DataFrame) -> DataFrame:
    """``docs``: (text, learn).  (word, n, n_all): its count in texts to learn from, and in all."""

    def run(batches):
        def rows(c, learn):
            keys, counts = list(c.keys()), list(c.values())
            for at in range(0, len(keys), 50_000):
                n = pa.array(counts[at : at + 50_000], pa.int64())
                part = pa.array(keys[at : at + 50_000], pa.binary())
                yield pa.RecordBatch.from_arrays([part, n if learn else pa.array(np.zeros(len(part), np.int64)), n], names=["word", "n", "n_all"])

        seen = {True: Counter(), False: Counter()}
        for b in steps(batches, 0, STEP):
            for t, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[bool(learn)].update(_words(t))
            for learn, c in seen.items():
                if len(c) > FLUSH:
                    yield from rows(c, learn)
                    c.clear()
        for learn, c in seen.items():
            yield from rows(c, learn)

    return docs.mapInArrow(run, "word binary, n long, n_all long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


# -- counts of strings


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    at = np.argsort(keys, kind="stable")
    keys, counts = keys[at], counts[at]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _near(code: Column, order: int, symbols: int) -> Column:
    """The nearest symbols of a string's context, as a number."""
    return F.shiftright(code, BITS * (order + 1 - symbols))


def count_strings(docs: DataFrame, order: int) -> DataFrame:
    """``docs``: (text binary, learn).  (near, code, n, n_all) of every distinct string of order + 1 symbols; near: its three nearest."""

    def run(batches):
        held = {True: [], False: []}

        def merged(learn):
            keys, counts = _add_up(*map(np.concatenate, zip(*held[learn])))
            held[learn] = [(keys, counts)]
            return keys, counts

        def rows(learn):
            keys, counts = merged(learn)
            held[learn] = []
            for at in range(0, len(keys), 100_000):
                n = pa.array(counts[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), n if learn else pa.array(np.zeros(len(n), np.int64)), n], names=["code", "n", "n_all"])

        for b in steps(batches, 0, STEP):
            learns = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = b.column(0).to_pylist()
            for learn in (True, False):
                mine = [t for t, y in zip(texts, learns.tolist()) if y == learn]
                if not mine:
                    continue
                x, _ = symbol_rows(mine, order)
                code = strings(x, order)
                keys, counts = np.unique(code[x[order:] != START], return_counts=True)
                held[learn].append((keys, counts.astype(np.int64)))
                if len(held[learn]) > 1 and sum(len(k) for k, _ in held[learn][1:]) > FLUSH_STRINGS and len(merged(learn)[0]) > FLUSH_STRINGS:
                    yield from rows(learn)
        for learn in (True, False):
            if held[learn]:
                yield from rows(learn)

    counted = docs.mapInArrow(run, "code long, n long, n_all long").withColumn("near", _near(F.col("code"), order, 3))
    return counted.repartition("near").groupBy("near", "code").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


# -- the context trie


class Level:
    """All contexts of one length in some part of the trie, and what followed them in training."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, parent: "Level | None"):
        """``grams``: sorted strings of a context and a symbol."""
        self.grams, self.counts = grams, counts
        context = grams >> BITS
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(grams) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.total = np.add.reduceat(counts, first) if len(grams) else counts
        self.distinct = np.diff(np.append(first, len(grams)))
        #: Counts in the context one shorter of the symbols seen here.
        self.above = np.zeros(len(first), np.int64)
        if parent is not None and len(grams):
            same = (context >> BITS) << BITS | grams & 511
            self.above = np.add.reduceat(parent.counts[np.searchsorted(parent.grams, same)], first)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def levels(codes: np.ndarray, counts: np.ndarray, longest: int, shortest: int, parent: Level | None = None) -> dict[int, Level]:
    """Levels from strings with contexts of ``longest`` symbols (sorted); ``parent``: the level below ``shortest``."""
    out = {}
    grams = {longest: (codes, counts)}
    for k in range(longest - 1, shortest - 1, -1):
        longer, n = grams[k + 1]
        grams[k] = _add_up((longer >> 2 * BITS) << BITS | longer & 511, n)
    for k in range(shortest, longest + 1):
        parent = out[k] = Level(*grams[k], parent)
    return out


def log10_probabilities(codes: np.ndarray, order: int, trie: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each string's symbol after its context."""
    out = np.zeros(len(codes))
    live = np.arange(len(codes))
    seen, kinds = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)  # of the context one longer: counts here, and number, of its symbols
    for k in range(order, -1, -1):
        level, context, symbol = trie[k], codes[live] >> BITS * (order + 1 - k), codes[live] & 511
        at = _find(level.contexts, context)
        met = at >= 0
        if not len(level.contexts):
            continue
        total, distinct = level.total[at] - seen, level.distinct[at] - kinds
        gram = _find(level.grams, context << BITS | symbol)
        hit, full = met & (gram >= 0), level.distinct[at] == SYMBOLS
        half = np.where(full, 0, 1)  # a context that all symbols have followed has nothing to escape to
        out[live[hit]] += np.log10((2 * level.counts[gram[hit]] - half[hit]) / (2 * total[hit]))
        miss = met & ~hit & (total > 0)
        out[live[miss]] += np.log10(distinct[miss] / (2 * total[miss]))
        go = ~hit
        seen = np.where(met, level.above[at], 0)[go]
        kinds = np.where(met, level.distinct[at], 0)[go]
        live = live[go]
    if len(live):
        out[live] -= np.log10(SYMBOLS - int(trie[0].distinct.sum()))  # the only context of no symbols, if any
    return out


def score_strings(counted: DataFrame, order: int) -> DataFrame:
    """(code, slot, n_all, logp) of every string of a written table of :func:`count_strings`; slot: a hash of the code."""
    gram = F.shiftleft(_near(F.col("code"), order, 2), BITS).bitwiseOR(F.col("code").bitwiseAND(F.lit(511).cast("long")))
    table = counted.where("n > 0").groupBy(gram.alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # columns of at most 258 ** 2 * 257 numbers
    grams, n = _add_up(table.column("gram").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.int64))
    sent = counted.sparkSession.sparkContext.broadcast(levels(grams, n, 2, 0))

    def run(batches):
        low = sent.value

        def block(code, n):
            known = n > 0
            trie = low | levels(code[known], n[known], order, 3, low[2])
            return log10_probabilities(code, order, trie)

        def rows(held, cut):
            """Scores the strings before the cut; the others stay."""
            code, n, n_all = (np.concatenate(c) for c in zip(*held))
            cut = len(code) if cut is None else cut
            logp = block(code[:cut], n[:cut])
            held[:] = [(code[cut:], n[cut:], n_all[cut:])]
            for at in range(0, cut, 100_000):
                to = min(cut, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(code[at:to]), pa.array(slots(code[at:to])), pa.array(n_all[at:to]), pa.array(logp[at:to])], names=["code", "slot", "n_all", "logp"])

        held = []
        for b in batches:
            held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            if sum(len(h[0]) for h in held) >= BLOCK:
                near = np.concatenate([h[0] for h in held]) >> BITS * (order - 2)
                cut = int(np.searchsorted(near, near[-1]))  # the last group may go on
                if cut:
                    yield from rows(held, cut)
        if held:
            yield from rows(held, None)

    ordered = counted.repartition("near").sortWithinPartitions("code").select("code", "n", "n_all")
    return ordered.mapInArrow(run, "code long, slot long, n_all long, logp double")


def slots(codes: np.ndarray, bits: int = 31) -> np.ndarray:
    """A multiplicative hash of strings, of so many bits."""
    return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


class HotTables:
    """Scores of a fixed set of strings, in a few directly mapped tables: what finds its place taken goes to the next."""

    def __init__(self, codes: np.ndarray, logp: np.ndarray):
        self.tables = []
        for _ in range(4):
            if not len(codes):
                break
            bits = max(4, int(len(codes)).bit_length())
            keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            at = slots(codes, bits)
            keys[at[::-1]], values[at[::-1]] = codes[::-1], logp[::-1]  # the first of those that share a place gets it
            self.tables.append((bits, keys, values))
            out = keys[at] != codes
            codes, logp = codes[out], logp[out]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (0 where not held) and the places of strings that aren't held."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k, (bits, keys, values) in enumerate(self.tables):
            c = codes if k == 0 else codes[left]
            at = slots(c, bits)
            hit = keys[at] == c
            if k == 0:
                out = np.where(hit, values[at], 0.0)
            else:
                out[left[hit]] = values[at[hit]]
            left = left[~hit]
        return out, left


def most_frequent(counted: DataFrame, most: int) -> pa.Table:
    """The rows of the words or strings above the least count that at most ``most`` of them exceed; a histogram finds it."""
    size = F.floor(F.log2(F.col("n_all").cast("double")) * 16).cast("int")
    bins = sorted(((r["bin"], r["n"]) for r in counted.groupBy(size.alias("bin")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 16 bins a doubling
    least, total = None, 0
    for b, n in bins:
        if (total := total + n) > most:
            break
        least = b
    if least is None:
        return counted.limit(0).toArrow()
    return counted.where(size >= least).toArrow()


# -- documents

EACH = "uid long, doc_id long, n_tokens long, known long, base double, score double, word binary, tf long, bucket int, uids binary, lengths binary, codes binary"


_COLUMNS = [(f, {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}[t]) for f, t in (c.split() for c in EACH.split(", "))]


def _rows(**columns) -> pa.RecordBatch:
    """A batch of document parts; columns not given are null."""
    n = len(next(iter(columns.values())))
    made = [pa.array(c, t) if (c := columns.get(f)) is not None and not isinstance(c, pa.Array) else c if c is not None else pa.nulls(n, t) for f, t in _COLUMNS]
    return pa.RecordBatch.from_arrays(made, names=[f for f, _ in _COLUMNS])


def _packed(uids: np.ndarray, owner: np.ndarray, codes: np.ndarray, buckets: int):
    """Rows (bucket, uids, lengths, codes) of strings to look up: runs of one bucket, in order of document."""
    bucket = slots(codes) % buckets
    at = np.lexsort((owner, bucket))
    bucket, owner, codes = bucket[at], owner[at], codes[at]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() + [len(codes)]
    for a, z in zip(edges, edges[1:]):
        for s in range(a, z, RUN):
            e = min(z, s + RUN)
            own = owner[s:e]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            yield int(bucket[s]), uids[own[first]].astype("<i8").tobytes(), np.diff(np.append(first, e - s)).astype("<i4").tobytes(), codes[s:e].astype("<i8").tobytes()


def look_up(each: DataFrame, scored: DataFrame, buckets: int) -> DataFrame:
    """(uid, score) partial sums of the packed strings of ``each``, from the table of scores, bucket by bucket."""
    table = scored.select((F.col("slot") % buckets).cast("int").alias("bucket"), F.lit(0).alias("kind"), "code", "logp")
    both = table.unionByName(each.where("codes is not null").select("bucket", F.lit(1).alias("kind"), "uids", "lengths", "codes"), allowMissingColumns=True)

    def run(batches):
        now, held, keys, values = None, [], None, None
        for b in batches:
            bucket, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            turn = bucket.astype(np.int64) * 2 + kind
            edges = np.flatnonzero(np.concatenate(([True], turn[1:] != turn[:-1]))).tolist() + [b.num_rows]
            for s, e in zip(edges, edges[1:]):
                part = b.slice(s, e - s)
                if bucket[s] != now:
                    now, held, keys = int(bucket[s]), [], None
                if kind[s] == 0:
                    held.append((part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)))
                    continue
                if keys is None:
                    keys, values = (np.concatenate(c) for c in zip(*held))
                    order = np.argsort(keys)
                    keys, values, held = keys[order], values[order], []
                uids, lengths, codes = (np.frombuffer(b"".join(part.column(k).to_pylist()), d) for k, d in ((4, "<i8"), (5, "<i4"), (6, "<i8")))
                found = values[np.searchsorted(keys, codes)]
                sums = np.add.reduceat(found, np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(sums)], names=["uid", "score"])

    parts = both.select("bucket", "kind", "code", "logp", "uids", "lengths", "codes").repartition("bucket").sortWithinPartitions("bucket", "kind")
    return parts.mapInArrow(run, "uid long, score double")


def score_documents(
    docs: DataFrame, held_out: int = 1, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot_words: int = HOT_WORDS, hot_strings: int = HOT_STRINGS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learned from the other folds.

    A null or empty text is its end alone.  A null id is in no fold and learned from.
    Repeated rows are learned from and scored each.  Without training rows the byte model
    is even and every base count 0; an empty table gives an empty table.  Further columns
    are ignored.
    """
    if not 3 <= order <= 6:
        raise ValueError("contexts have 3 to 6 symbols")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    taught = rows.select("text", (F.coalesce(fold("doc_id", folds), F.lit(-1)) != held_out).alias("learn"))
    words = materialize(count_words(taught), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    hot = most_frequent(words, hot_words)
    scored = materialize(score_strings(materialize(count_strings(taught, order), "strings"), order), "scored-strings")
    top = most_frequent(scored.select("code", "n_all", "logp"), hot_strings)
    buckets = LEAST_BUCKETS + scored.count() // BUCKET
    by_count = np.argsort(-top.column("n_all").to_numpy(), kind="stable")
    tables = HotTables(top.column("code").to_numpy()[by_count].astype(np.int64), top.column("logp").to_numpy()[by_count])
    sent = spark.sparkContext.broadcast((tables, hot.column("word").combine_chunks(), hot.column("n").to_numpy()))

    def run(batches):
        strings_of, hot_list, hot_counts = sent.value
        known = dict(zip(hot_list.to_pylist(), zip((hot_counts > 0).tolist(), np.log10(hot_counts + 0.5).tolist())))
        for b in steps(batches, 2, STEP):
            uids, ids, texts = b.column(0).to_numpy(), b.column(1), b.column(2).to_pylist()
            x, begin = symbol_rows(texts, order)
            code = strings(x, order)
            real = np.flatnonzero(x[order:] != START)
            code = code[real]
            value, cold = strings_of.find(code)
            first = begin - order * np.arange(len(begin))  # the place of each text's first string among the real ones
            score = np.add.reduceat(value, first)
            packed = list(_packed(uids, np.searchsorted(first, cold, side="right") - 1, code[cold], buckets)) if len(cold) else []
            own, each = [], []
            for u, t in zip(uids.tolist(), texts):
                tokens, found, base = 0, 0, 0.0
                for w, m in _words(t).items():
                    tokens += m
                    if (g := known.get(w)) is not None:
                        found += m * g[0]
                        base += m * g[1]
                    else:
                        each.append((u, w, m))
                own.append((tokens, found, base))
            yield _rows(uid=pa.array(uids), doc_id=ids, n_tokens=[o[0] for o in own], known=[o[1] for o in own], base=[o[2] for o in own], score=pa.array(score))
            if each:
                yield _rows(uid=[e[0] for e in each], word=[e[1] for e in each], tf=[e[2] for e in each])
            if packed:
                yield _rows(bucket=[p[0] for p in packed], uids=[p[1] for p in packed], lengths=[p[2] for p in packed], codes=[p[3] for p in packed])

    # Both lookups read one written table: a row's number can't change between them.
    each = materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(run, EACH), "document-parts")
    met = each.where("word is not null").select("uid", "word", "tf").join(words.select("word", "n"), "word")
    parts = (
        each.where("n_tokens is not null").select("uid", "doc_id", "n_tokens", "known", "base", "score")
        .unionByName(met.select("uid", F.when(F.col("n") > 0, F.col("tf")).otherwise(0).alias("known"), (F.col("tf") * F.log10(F.col("n") + 0.5)).alias("base")), allowMissingColumns=True)
        .unionByName(look_up(each, scored, buckets), allowMissingColumns=True)
    )
    summed = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "score")))
    whole = float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    return summed.select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * whole).alias("base_score"),
        "score",
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
