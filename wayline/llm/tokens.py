"""Shared parts of the tokenising operators: recent-result caches and tokenizer encoding of whole texts.

A text is cut before each space that follows a character other than white space: no
pre-token of a byte-level tokenizer spans such a place, so a text's ids are the ids of its
pieces in order.  (For tokenizers that drop white space, every white-space run is a cut.)
Pieces repeat a lot: Arrow numbers the distinct pieces of a step, each worker keeps the ids
of recent ones in packed arrays of bounded size, asks the library only for the others, and
Arrow puts the ids of all pieces in order.  Texts for which a cut would not be safe go to the library
whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Text bytes that one step of a worker holds at a time; a single longer text is a step of its own.
STEP_BYTES = 8 << 20
#: Bytes of recent results that a worker keeps.
RECENT_BYTES = 32 << 20
#: Longer pieces aren't kept.
LONGEST_KEPT = 200

_SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space behind white space, and separators that splitting takes for white space but tokenizers don't.
SPACED_SPACE = f"[{_SPACES} ] "
ODD_SPACE = r"[\x1c-\x1f]"


class Recent:
    """Results of recent keys as two packed arrays; when these exceed ``most`` bytes, the older half goes."""

    def __init__(self, most: int | None = None, key: pa.DataType = pa.string()):
        self.most, self.keys, self.results = RECENT_BYTES if most is None else most, pa.array([], key), pa.array([], pa.large_binary())

    def values(self, keys: pa.Array, compute) -> pa.Array:
        """The results of distinct ``keys``; ``compute`` gives those of a list of keys not met lately, as a list of bytes."""
        at = pc.index_in(keys, value_set=self.keys)
        if not at.null_count:
            return self.results.take(at)
        unknown = pc.is_null(at)
        new = keys.filter(unknown)
        results = pa.array(compute(new.to_pylist()), pa.large_binary())
        place, mask = pc.fill_null(at, 0).to_numpy().astype(np.int64), unknown.to_numpy(zero_copy_only=False)
        place[mask] = len(self.keys) + np.arange(len(new))
        both = pa.concat_arrays([self.results, results])
        short = pc.less_equal(pc.binary_length(new), LONGEST_KEPT)
        self.keys, self.results = pa.concat_arrays([self.keys, new.filter(short)]), pa.concat_arrays([self.results, results.filter(short)])
        if self.keys.nbytes + self.results.nbytes > self.most:
            later = pa.array(np.arange(len(self.keys) // 2, len(self.keys)))
            self.keys, self.results = self.keys.take(later), self.results.take(later)
        return both.take(pa.array(place))


def in_order(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Values one behind the other: their ends (with a leading 0) and bytes."""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64, len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, np.int64)
    return ends, memoryview(data or b"")


class Pieces:
    """Results of the pieces of texts.  A piece of letters with sentence marks behind has the results of both, one behind the other."""

    MARKS = ".,;:!?"

    def __init__(self, results_of, results_of_marks):
        """``results_of`` computes results of pieces, ``results_of_marks`` of marks that follow letters; both of a list."""
        self.recent, self.results_of, self.results_of_marks, self.marks = Recent(), results_of, results_of_marks, {"": b""}

    def values(self, pieces: pa.Array) -> pa.Array:
        bare = pc.utf8_rtrim(pieces, self.MARKS)
        letters = pc.and_(pc.utf8_is_alpha(bare), pc.utf8_is_alpha(pc.utf8_lower(pc.utf8_normalize(bare, "NFC"))))  # and stay so in normal form
        marked = pc.and_(pc.not_equal(pc.binary_length(bare), pc.binary_length(pieces)), letters)
        keys = pc.if_else(marked, bare, pieces).dictionary_encode()
        values = self.recent.values(keys.dictionary, self.results_of).take(keys.indices)
        behind = [p[len(b) :] for p, b in zip(pieces.filter(marked).to_pylist(), bare.filter(marked).to_pylist())]
        if not behind:
            return values
        known = self.marks if len(self.marks) < 10_000 else {"": b""}
        if new := [m for m in dict.fromkeys(behind) if m not in known]:
            known.update(zip(new, self.results_of_marks(new), strict=True))
        self.marks = known
        tails = pa.array([known[m] for m in behind], pa.large_binary())
        place = np.zeros(len(pieces), np.int64)
        place[marked.to_numpy(zero_copy_only=False)] = 1 + np.arange(len(behind))
        tails = pa.concat_arrays([pa.array([b""], pa.large_binary()), tails]).take(pa.array(place))
        return pc.binary_join_element_wise(values, tails, pa.scalar(b"", pa.large_binary()))


def whole_ids(texts: pa.Array, spaced: bool, first: Pieces | None, rest: Pieces) -> list[bytes]:
    """Results of texts that may be cut: before single spaces (their first pieces have results of their own), or at all white space."""
    lists = pc.split_pattern(texts, " ") if spaced else pc.utf8_split_whitespace(texts)
    at, flat = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))), lists.flatten().dictionary_encode()
    values, place = rest.values(flat.dictionary), flat.indices.to_numpy()
    if spaced:
        begin = flat.dictionary.take(flat.indices.take(pa.array(at[:-1]))).dictionary_encode()
        place = place.astype(np.int64)
        place[at[:-1]] = begin.indices.to_numpy().astype(np.int64) + len(values)
        values = pa.concat_arrays([values, first.values(begin.dictionary)])
    ends, data = in_order(values.take(pa.array(place)))
    places = ends[at].tolist()
    return [bytes(data[a:b]) for a, b in zip(places, places[1:])]


def steps(batches, column: int, size: int = STEP_BYTES):
    """Cut record batches into runs of rows with about ``size`` bytes of the text (or binary) column."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield b.slice(at, to - at)
            at = to


def byte_symbols() -> dict[int, str]:
    """The characters by which byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(other)}


class TextEncoder:
    """Ids of whole texts by one tokenizer file of the tokenizers library, as ``encode(text, add_special_tokens=False)``.

    Strings of special tokens in a text become those tokens, as is the library's rule, or with
    ``special_as_text`` ordinary text.  For tokenizers with word ends, pieces of letters
    go to the library's model without its slower front part.  ``narrow``: ids as 16-bit numbers (for
    vocabularies of at most 65,536).
    """

    def __init__(self, path: str, narrow: bool = False, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        spec = json.load(open(path))
        pre = spec.get("pre_tokenizer") or {}
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            self.kind = "spaced"
        elif pre.get("type") == "Sequence" and '\\s+' in json.dumps(spec.get("normalizer") or {}).replace("\\\\", "\\") and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.kind = "split"
        size = self.lib.get_vocab_size()
        if narrow and size > 65536:
            raise ValueError("the vocabulary is too large for 16-bit ids")
        self.dtype = "<u2" if narrow else "<u4"
        self.spell = byte_symbols()
        names = [self.lib.id_to_token(i) or "" for i in range(size)]
        self.starts = np.array([n.startswith("\u0120") for n in names])
        self.mark = self.ends = None
        if self.kind == "split":  # a symbol that is one token on its own parts the pieces of a joint text
            self.mark = next((c, i[0]) for c in "★☆♠♣♥♦♪|" if len(i := self.lib.encode(c, add_special_tokens=False).ids) == 1)
            if suffix := spec["model"].get("end_of_word_suffix"):
                self.ends, self.bare = np.array([n.endswith(suffix) for n in names]), Tokenizer(self.lib.model)
        #: Texts that hold a special token's string, in any case, go to the library whole.
        self.special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens") or []]
        self.first, self.rest = None, Pieces(self._ended if self.ends is not None else self._split, self._whole)
        if self.kind == "spaced":
            self.first, self.rest = Pieces(self._whole, self._whole), Pieces(self._spaced, self._whole)

    def _ids(self, text, **how) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False, **how)[0].ids, dtype=self.dtype)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of ' ' + piece: only the first token of each holds its space."""
        out = []
        for k in range(0, len(pieces), 512):
            part = pieces[k : k + 512]
            ids = np.zeros(0, self.dtype) if "" in part else self._ids(" " + " ".join(part))
            at = np.append(np.flatnonzero(self.starts[ids]), len(ids)).tolist()
            out += [ids[a:b].tobytes() for a, b in zip(at, at[1:])] if len(at) == len(part) + 1 else self._whole([" " + p for p in part])
        return out

    def _split(self, pieces: list[str]) -> list[bytes]:
        mark, mark_id = self.mark
        out = []
        for k in range(0, len(pieces), 512):
            part = pieces[k : k + 512]
            at = None
            if not any(mark in p for p in part):
                ids = self._ids(f" {mark} ".join(part))
                at = [-1, *np.flatnonzero(ids == mark_id).tolist(), len(ids)]
            out += [ids[a + 1 : b].tobytes() for a, b in zip(at, at[1:])] if at and len(at) == len(part) + 1 else self._whole(part)
        return out

    def _word(self, letters: str) -> str | None:
        """A piece of letters as the model spells it; None if it needs the whole chain."""
        if letters.isascii():
            return letters.lower()
        if "\u03a3" in letters or not unicodedata.is_normalized("NFC", letters) or not (letters := letters.lower()).isalpha():
            return None
        return letters.encode().decode("latin-1").translate(self.spell)

    def _ended(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters by the model, of others by the whole chain."""
        out, words = [b""] * len(pieces), []
        other = []
        for k, p in enumerate(pieces):
            if p.isalpha() and (w := self._word(p)) is not None:
                words.append((k, w))
            else:
                other.append(k)
        for at in range(0, len(words), 512):
            own, part = zip(*words[at : at + 512])
            ids = np.array(self.bare.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=self.dtype)
            cut = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cut) == len(part) + 1 and cut[-1] == len(ids):
                for k, a, b in zip(own, cut, cut[1:]):
                    out[k] = ids[a:b].tobytes()
            else:
                other += own
        for k, ids in zip(other, self._split([pieces[k] for k in other])):
            out[k] = ids
        return out

    def _unsafe(self, texts: pa.Array) -> np.ndarray:
        """Texts that must not be cut."""
        out = pc.match_substring_regex(texts, SPACED_SPACE if self.kind == "spaced" else ODD_SPACE)
        for s in self.special:
            out = pc.or_(out, pc.match_substring(texts, s, ignore_case=True))
        return out.to_numpy(zero_copy_only=False).astype(bool)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.kind == "whole" or not len(texts):
            return self._whole(texts.to_pylist())
        unsafe = self._unsafe(texts)
        out: list = [None] * len(texts)
        for n, ids in zip(np.flatnonzero(unsafe).tolist(), self._whole(texts.filter(pa.array(unsafe)).to_pylist())):
            out[n] = ids
        if not unsafe.all():
            plain = texts.filter(pa.array(~unsafe))
            if self.kind == "split":
                plain = pc.ascii_lower(plain)  # as the tokenizer does to all letters
            for n, ids in zip(np.flatnonzero(~unsafe).tolist(), whole_ids(plain, self.kind == "spaced", self.first, self.rest)):
                out[n] = ids
        return out


_ENCODERS: dict[tuple[str, bool, bool], TextEncoder] = {}


def encoder(path: str, narrow: bool = False, special_as_text: bool = False) -> TextEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    key = path, narrow, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def encode_texts(
    docs: DataFrame, tokenizer_path: str, end_id: int | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), narrow: bool = False, special_as_text: bool = False
) -> DataFrame:
    """``keep`` columns, n_tokens and ids (binary, little-endian unsigned 32-bit) of each row's whole text.

    A null text is empty; ``end_id`` is appended to every text if given; ``narrow`` makes the ids 16-bit;
    ``special_as_text`` treats the strings of special tokens as ordinary text, instead of as those tokens.
    """
    kept = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    width = 2 if narrow else 4
    end = b"" if end_id is None else end_id.to_bytes(width, "little")
    last = len(keep)

    def run(batches):
        lib = encoder(tokenizer_path, narrow, special_as_text)
        for b in steps(batches, last):
            ids = [x + end for x in lib.encode(b.column(last))]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "ids"])

    schema = kept.drop("_text").schema.add("n_tokens", "long").add("ids", "binary")
    return kept.mapInArrow(run, schema)
