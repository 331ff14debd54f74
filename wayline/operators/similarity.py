"""Exact set-similarity joins of texts by their word n-grams."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayline.plans.running import running_sum
from wayline.plans.storage import materialize, release


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9./:_\-]+"), 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


#: The grams of a text that is null: one that stands for that.
_NONE = np.array([42], np.int64)


def _grams(tokens: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct hashes, sorted, of the n-grams of sequences of token hashes; of single tokens if there are fewer than n."""
    t = tokens.view(np.uint64)
    single, joined = _mixed(t ^ np.uint64(0xD6E8FEB86659FD93)), t[: max(len(t) - n + 1, 0)]
    for i in range(1, n):
        joined = _mixed(joined) + t[i : i + len(joined)]
    single, joined = single.view(np.int64), _mixed(joined).view(np.int64)
    return [np.unique(single[i:j] if j - i < n else joined[i : j - n + 1]) for i, j in zip(offsets[:-1], offsets[1:])]


#: Rows whose lists are held as arrays at once.
_STEP = 256


#: Words of a file are mostly numbers in its dictionary if that may hold a million of them.
_LARGE_DICTIONARY = {"parquet.dictionary.page.size": str(8 << 20)}


def _sets(lists: pa.Array, n: int) -> list[np.ndarray]:
    """The grams of lists of token hashes."""
    offsets, none = lists.offsets.to_numpy().astype(np.int64), lists.is_null().to_numpy(zero_copy_only=False)
    return [_NONE if x else g for x, g in zip(none, _grams(lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0], n))]


def _steps(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            yield batch.slice(at, _STEP)


def gram_sets(cases: DataFrame, n: int = 3, text: str = "trace") -> DataFrame:
    """``cases`` without ``text``, with words (hashes of its tokens, in order), m (how many distinct grams of ``n`` they have), key (hash of these) and k (its first 64 bits); written once.

    Tokens are hashed by an expression; only hashes go to the tasks' Python, beside the other columns.  Words repeat
    and so take a fraction of the room of grams, which are made from them where they are needed.
    """
    # The tokens are a column of their own, or each hash would cut the text again.
    hashed = cases.withColumn("words", tokens_of(F.col(text))).withColumn("words", F.transform("words", lambda x: F.xxhash64(x)))
    kept = [c for c in cases.columns if c != text]

    def run(batches):
        for b in _steps(batches):
            made = _sets(b.column(len(kept)), n)
            keys = [hashlib.sha256(g.tobytes()) for g in made]
            new = [pa.array(np.array([len(g) for g in made], np.int32)), pa.array([x.hexdigest() for x in keys]), pa.array(np.array([int.from_bytes(x.digest()[:8], "little", signed=True) for x in keys], np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*kept, "words", "m", "key", "k"])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in cases.select(*kept).schema], T.StructField("words", T.ArrayType(T.LongType())), T.StructField("m", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("k", T.LongType())])
    return materialize(hashed.select(*kept, "words").mapInArrow(run, schema), "words", _LARGE_DICTIONARY)


#: Classes looked at for frequent grams, in how many of them a gram is frequent, and how many grams may be.
LOOKED_AT, OFTEN, MOST_FREQUENT = 20_000, 10, 65_536


def _frequent(rows: DataFrame, n: int, classes: int) -> np.ndarray:
    """Grams that occur often, by a share of the classes dealt by hash.  They only steer which parts are formed: results don't depend on them."""

    def run(batches):
        for b in _steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_sets(b.column(0), n)))], names=["g"])

    share = rows.where(F.pmod("k", F.lit(max(1, classes // LOOKED_AT))) == 0).select("k", "words").dropDuplicates(["k"])
    found = share.select("words").mapInArrow(run, "g bigint").groupBy("g").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "g").limit(MOST_FREQUENT).select("g").collect()
    return np.array(sorted(r["g"] for r in found), np.int64)


@lru_cache(65_536)
def _band(b: int, threshold: float) -> tuple[int, int, int]:
    """How many grams may differ in a band of sizes, the number of its parts, and its largest size."""
    longest = math.ceil(threshold ** -(b + 1) * (1 + 1e-6))
    differ = math.floor((1 - threshold) / threshold * longest + 1e-6)
    return differ, differ + 3 + differ // 8, longest


def _differ(sizes: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """How many grams two sets of these sizes may have that the other hasn't."""
    return np.floor((1 - threshold) / (1 + threshold) * (sizes + others) + 1e-6).astype(np.int64)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by place, modulo 2^64: halves add up exactly as doubles."""
    low, high = (np.bincount(at, v.astype(np.float64), n).astype(np.uint64) for v in (values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)))
    return low + (high << np.uint64(32))


#: Signatures have 40 bits, of which the last two tell even bands, odd ones and prefixes apart.  Some false meetings only cost a comparison.
_BYTES, _PREFIX = 5, 2


def _signature(x: np.ndarray, tag) -> np.ndarray:
    return (x >> np.uint64(64 - 8 * _BYTES)).view(np.int64) & ~3 | tag


def _parts(grams: np.ndarray, sizes: np.ndarray, threshold: float, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, number of the set, how many of the tag a similar set shares at least) of sets of grams, each sorted, one after another, and
    how many parts with grams each set has in its own band; see :func:`shared_parts`."""
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    often = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams if len(frequent) else np.zeros(len(grams), bool)
    mixed, own, poor, out, filled_own = _mixed(grams[~often].view(np.uint64)), owner[~often], np.zeros(n, bool), [], None
    again = _mixed(mixed)
    band = np.floor(np.log(np.maximum(sizes, 1)) / -math.log(threshold) + 1e-9).astype(np.int64) if threshold < 1 else np.zeros(n, np.int64)
    for b in (band, band - 1) if threshold < 1 else (band,):
        values, which = np.unique(b, return_inverse=True)
        differ, parts, longest = np.array([_band(int(x), threshold) for x in values], np.int64).reshape(-1, 3)[which].T
        start = np.cumsum(parts) - parts
        at = start[own] + (mixed % parts.astype(np.uint64)[own]).astype(np.int64)
        total = int(parts.sum())
        filled = np.flatnonzero(np.bincount(at, minlength=total))
        of = np.repeat(np.arange(n), parts)[filled]
        held = np.bincount(of, minlength=n)
        poor |= held <= differ
        # Sets of the same or a higher band are met in a set's own band, those of the lower one in that.
        need = np.maximum(held - _differ(sizes, np.floor(sizes / threshold + 1e-6) if filled_own is None else longest, threshold), 1)
        filled_own = held if filled_own is None else filled_own
        name = (filled - start[of]).astype(np.uint64) + ((b[of] + 2).astype(np.uint64) << np.uint64(40))
        out.append((_signature(_mixed(_sums(at, again, total)[filled] + _mixed(name)), b[of] & 1), of, need[of]))
    poor &= sizes > 0
    if poor.any():  # too many empty parts: the prefix of the set as well, frequent grams last
        held = np.flatnonzero(poor[owner])
        held = held[np.argsort(owner[held] * 2 + often[held], kind="stable")]
        m = sizes[poor]
        rank = np.arange(len(held)) - np.repeat(np.cumsum(m) - m, m)
        held = held[rank < np.repeat(m - np.ceil(threshold * m - 1e-9).astype(np.int64) + 1, m)]
        out.append((_signature(_mixed(grams[held].view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), _PREFIX), owner[held], np.ones(len(held), np.int64)))
    return *(np.concatenate(x) for x in zip(*out)), filled_own


def _parts_of(grams: np.ndarray, threshold: float, frequent: np.ndarray) -> np.ndarray:
    """The signatures of one set of grams, sorted."""
    return np.unique(_parts(grams, np.array([len(grams)]), threshold, frequent)[0])


_SIGNED = np.dtype([("sig", "<i8"), ("k", "<i8"), ("need", "<i4")])
#: Sets whose signatures are dealt to buckets at once, and sets per bucket, on average.
_DEALT, _PER_BUCKET = 2_048, 4_096
#: What a signature takes in an exchange: itself, its set and what is needed.
_PACKED = _BYTES + 8 + 2


def _pack(x: np.ndarray) -> bytes:
    """Signatures column by column, without the bytes that are always zero."""
    least = np.minimum(x["need"], 65_535).astype("<u2")  # less is asked of huge sets
    return np.ascontiguousarray(x["sig"]).view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes() + x["k"].tobytes() + least.tobytes()


def _unpacked(batches):
    """Rows (bucket, signed) as records."""
    for b in batches:
        made = []
        for packed in b.column(1):
            raw = np.frombuffer(packed.as_buffer(), np.uint8)
            n = len(raw) // _PACKED
            x, sig = np.empty(n, _SIGNED), np.zeros((n, 8), np.uint8)
            sig[:, :_BYTES] = raw[: n * _BYTES].reshape(n, _BYTES)
            x["sig"], x["k"], x["need"] = sig.view("<i8")[:, 0], raw[n * _BYTES : n * (_BYTES + 8)].view("<i8"), raw[n * (_BYTES + 8) :].view("<u2")
            made.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["bucket", "signed"])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = x[np.lexsort((x["k"], x["sig"]))]
    return x[np.concatenate([[True], (x["sig"][1:] != x["sig"][:-1]) | (x["k"][1:] != x["k"][:-1])])] if len(x) else x


def _met(x: np.ndarray) -> pa.RecordBatch:
    """Those of distinct signatures, sorted, that several sets have."""
    same = x["sig"][1:] == x["sig"][:-1]
    x = x[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(x) else x
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in _SIGNED.names], names=_SIGNED.names)


def _meeting(batches):
    """Of rows (bucket, signed) in order of bucket: the signatures that several sets have.  Repeated ones go before they pile up."""
    at, held, n, limit = None, [], 0, 1 << 20
    for b in batches:
        for bucket, signed in zip(b.column(0).to_numpy(), b.column(1)):
            if at is not None and bucket != at:
                yield _met(_distinct(np.concatenate(held)))
                held, n, limit = [], 0, 1 << 20
            at = bucket
            held.append(np.frombuffer(signed.as_buffer(), _SIGNED))
            n += len(held[-1])
            if n > limit:
                held = [_distinct(np.concatenate(held))]
                n, limit = len(held[0]), max(limit, 2 * len(held[0]))
    if held:
        yield _met(_distinct(np.concatenate(held)))


def shared_parts(rows: DataFrame, n: int, threshold: float, frequent: np.ndarray, classes: int) -> DataFrame:
    """(sig, k, need) of sets (k, words: of them grams of ``n``), of signatures that several have: two sets with a Jaccard similarity of at least ``threshold`` share one.

    Sizes fall into bands that grow by 1 / threshold, so two such sets meet in the band of the smaller, in which
    at most d grams differ.  Grams are dealt to more than d parts by hash, so some part is the same in
    both; its hash is a signature.  Empty parts have none: a set with so many that an equal part might be empty gives
    its prefix too (of two such sets the first grams in one order, of which they must share one); if only one is
    such a set, the other has few enough empty parts.  Parts are formed without ``frequent`` grams, as what differs only gets less by that.

    Each gram that differs spoils one part only, so similar sets share all but d of the smaller one's parts with grams:
    need says how many of a tag a set must share to have a similar one at all.

    Signatures are most of the rows of the join, so they are exchanged many to a row, by buckets that hold some
    thousand sets' share each; only those that several sets have become rows of their own.
    """
    buckets = max(64, classes // _PER_BUCKET)

    def run(batches):
        def dealt():
            signed = np.concatenate(made)
            to = (signed["sig"] % buckets).astype(np.int32)
            order = np.argsort(to, kind="stable")
            own, first = np.unique(to[order], return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array([_pack(x) for x in np.split(signed[order], first[1:])], pa.binary())], names=["bucket", "signed"])

        made, held = [], 0
        for b in _steps(batches):
            sets = _sets(b.column(1), n)
            sigs, of, need, _ = _parts(np.concatenate(sets), np.array([len(x) for x in sets]), threshold, frequent)
            order = np.argsort(of, kind="stable")
            signed = np.empty(len(sigs), _SIGNED)
            signed["sig"], signed["k"], signed["need"] = sigs[order], b.column(0).to_numpy()[of[order]], need[order]
            if len(signed):
                made.append(signed)
            held += len(sets)
            if made and held >= _DEALT:
                yield dealt()
                made, held = [], 0
        if made:
            yield dealt()

    dealt = rows.select("k", "words").mapInArrow(run, "bucket int, signed binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _meeting(_unpacked(batches)), "sig bigint, k bigint, need int")


def _common(left: pa.Array, right: pa.Array) -> pa.Array:
    """How many values the sets of each row, both sorted, have in common."""
    (a, i), (b, j) = ((x.values.to_numpy(), x.offsets.to_numpy()) for x in (left, right))
    out = np.empty(len(left), np.int32)
    for r in range(len(left)):
        both = np.concatenate([a[i[r] : i[r + 1]], b[j[r] : j[r + 1]]])
        both.sort(kind="stable")  # two runs are merged
        out[r] = np.count_nonzero(both[1:] == both[:-1])
    return pa.array(out)


#: Grams of a block of sets, and how many of them a set counts as at least.
_BLOCK, _SET = 2_097_152, 1_024
#: Grams of the pairs that are compared at once.
_COMPARED = 1 << 20


def _shared(sigs: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, how many signatures they share) of sets i of ``low`` and j of ``high`` that share any."""
    order = np.lexsort((of, sigs))
    sigs, of = sigs[order], of[order]
    row, column = np.full(len(low) + len(high), -1), np.full(len(low) + len(high), -1)
    row[low], column[high] = np.arange(len(low)), np.arange(len(high))
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(sigs))
    count = np.zeros((len(low), len(high)), np.int32)
    for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        r, c = row[of[s:e]], column[of[s:e]]
        count[np.ix_(r[r >= 0], c[c >= 0])] += 1
    i, j = np.nonzero(count)
    return low[i], high[j], count[i, j]


def _compared(n: int, threshold: float, frequent: np.ndarray, cross_split_only: bool, exclude_same_group: bool):
    """A function from the sets of two blocks, or of one, to their similar pairs."""

    def run(table: pa.Table) -> pa.Table:
        block, lists = table.column("block").to_numpy(), table.column("grams").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes, offsets, values = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        signed = []
        for at in range(0, len(sizes), _STEP):
            own = sizes[at : at + _STEP]
            sigs, of, _, filled = _parts(values[offsets[at] : offsets[at + len(own)]], own, threshold, frequent)
            signed.append((sigs, of + at, filled))
        sigs, of, filled = (np.concatenate(x) for x in zip(*signed))
        one = block.min() == block.max()
        low, high = (np.arange(len(block)),) * 2 if one else (np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max()))
        i, j, shared = _shared(sigs, of, low, high)
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        less = np.where(sizes[i] <= sizes[j], i, j)
        keep = (small >= threshold * large - 1e-9) & (shared >= filled[less] - _differ(small, large, threshold))
        if one:
            keep &= i < j
        for name, asked in (("split", cross_split_only), ("group", exclude_same_group)):
            if asked:
                code = table.column(name).combine_chunks().dictionary_encode()
                code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy()
                keep &= (code[i] != code[j]) | (code[i] < 0)
        i, j = i[keep], j[keep]
        both, total = [np.zeros(0, np.int64)], np.cumsum(sizes[i] + sizes[j])
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _COMPARED)))
            both.append(_common(lists.take(pa.array(i[at:to])), lists.take(pa.array(j[at:to]))).to_numpy())
            at = to
        both = np.concatenate(both)
        similarity = both / (sizes[i] + sizes[j] - both)
        i, j, similarity = (x[similarity >= threshold] for x in (i, j, similarity))
        left, right = (table.column("class").take(pa.array(x)) for x in (i, j))
        less = pa.compute.less(left, right)
        return pa.table([pa.compute.if_else(less, left, right), pa.compute.if_else(less, right, left), pa.array(similarity)], names=["left_class", "right_class", "similarity"])

    return run


#: Places that tell which classes may be asked for.
_SLOTS = 1 << 22


def _picked(rows: DataFrame, ks: DataFrame, n: int) -> DataFrame:
    """(k, grams) of ``rows``: all whose k is among ``ks``, and few others; copies in a task once.  Only a bit for each of a fixed number of places goes to the tasks."""
    marked = np.zeros(_SLOTS, bool)
    marked[ks.select(F.pmod("k", F.lit(_SLOTS)).cast("int").alias("at")).distinct().toArrow().column(0).to_numpy()] = True
    packed = np.packbits(marked)

    def run(batches):
        marked, seen = np.unpackbits(packed).astype(bool), set()
        for b in _steps(batches):
            k = b.column(0).to_numpy()
            at = [i for i in np.flatnonzero(marked[k % _SLOTS]).tolist() if k[i] not in seen and not seen.add(k[i])]
            if at:
                made = _sets(pa.concat_arrays([b.column(1).take(pa.array(at))]), n)
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))], names=["k", "grams"])

    return rows.select("k", "words").mapInArrow(run, "k bigint, grams array<bigint>")


def near_duplicates(cases: DataFrame, threshold: float = 0.82, n: int = 3, cross_split_only: bool = False, exclude_same_group: bool = True, id_col: str = "case_id", text: str = "trace") -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of cases with a Jaccard similarity of at least ``threshold``.

    pairs: (left_class, right_class, similarity) between classes of equal gram sets, named
    by their smallest id; a class pairs with itself (similarity 1) if it has several
    members.  members: (id, class, split, group).  Copies are thus never expanded: join
    members on both sides for pairs of cases.  With ``cross_split_only`` or
    ``exclude_same_group`` a pair of classes stays if some of its pairs of members qualifies.

    Candidates share parts: see :func:`shared_parts`.  Only they meet their grams, a block of sets at a time.
    """
    has = set(cases.columns)
    base = cases.select(F.col(id_col).alias("id"), (F.col("split") if "split" in has else F.lit(None).cast("string")).alias("split"), (F.col("group_id") if "group_id" in has else F.lit(None).cast("string")).alias("group_id"), F.col(text).alias("text"))
    return near_sets(gram_sets(base, n, "text"), threshold, cross_split_only, exclude_same_group, n)


def near_sets(rows: DataFrame, threshold: float = 0.82, cross_split_only: bool = False, exclude_same_group: bool = True, n: int = 3, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What :func:`near_duplicates` gives, of rows (id, split, group_id, words, m, key, k) of :func:`gram_sets`.

    ``words`` has (k, words) where the rows themselves don't, as after a join that words needn't go through.

    Classes with enough shared signatures are laid out so that those that share the commonest ones are neighbours, and cut into
    blocks.  Each goes to the pairs of blocks in which it shares a signature, so grams are sent once per block and not once per pair.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    words = rows if words is None else words
    only = lambda c, one: F.when(one, c)
    classes = rows.groupBy("key", "k").agg(F.min("id").alias("class"), F.count("*").alias("n"), F.max("m").alias("m"), F.array_sort(F.collect_set("split")).alias("splits"), F.min("group_id").alias("least"), F.max("group_id").alias("most"))
    classes = materialize(classes.select("key", "k", "class", "n", "m", only(F.get("splits", F.lit(0)), F.size("splits") == 1).alias("split"), only(F.col("least"), F.col("least") == F.col("most")).alias("group")), "classes")
    members = rows.select("id", "split", "group_id", "key").join(classes.select("key", "class"), "key").select("id", "class", "split", "group_id")
    count = classes.count()
    frequent = _frequent(words, n, count)
    release(rows.sparkSession)
    # Copies sign alike; one exchange brings all that have a part together.
    met = materialize(shared_parts(words, n, threshold, frequent, count), "parts")
    release(rows.sparkSession)
    enough = met.groupBy("k", F.col("sig").bitwiseAND(F.lit(3)).alias("tag")).agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("k").distinct()
    met = met.select("sig", "k").join(enough, "k", "left_semi")
    met = materialize(met.join(met.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "sig"), "met")
    near = met.groupBy("k").agg(F.max(F.struct("c", "sig")).alias("top")).join(classes.select("k", "m"), "k").select(F.col("top.sig").alias("at"), "k", (F.col("m") + _SET).cast("long").alias("weight"))
    placed = running_sum(near, ["at", "k"], "weight").select("k", F.floor(F.col("before") / _BLOCK).cast("int").alias("block"))
    on = met.select("sig", "k").join(placed, "k")
    others = on.groupBy("sig", F.col("block").alias("other")).agg(F.count("*").alias("c"))
    tiles = on.join(others, "sig").where("block <> other or c > 1").select("k", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).distinct()
    wanted = materialize(tiles.join(classes.select("k", "class", "split", "group"), "k"), "tiles")
    release(rows.sparkSession)
    sets = _picked(words, wanted, n).dropDuplicates(["k"]).join(wanted, "k").select("low", "high", "block", "class", "split", "group", "grams")
    kind = classes.schema["class"].dataType
    schema = T.StructType([T.StructField("left_class", kind), T.StructField("right_class", kind), T.StructField("similarity", T.DoubleType())])
    far = materialize(sets.groupBy("low", "high").applyInArrow(_compared(n, threshold, frequent, cross_split_only, exclude_same_group), schema), "pairs")
    release(rows.sparkSession)
    own = classes.where("n > 1")
    if cross_split_only:
        own = own.where("split is null")
    if exclude_same_group:
        own = own.where("`group` is null")
    return far.unionByName(own.select(F.col("class").alias("left_class"), F.col("class").alias("right_class"), F.lit(1.0).alias("similarity"))), members
