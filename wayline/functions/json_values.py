"""JSON texts as values: parsed once, and written again as ECMAScript writes them.

Numbers are doubles and read as their shortest decimal form (``25000000.5``, ``1000`` for
``1e3``, ``1e-7``); objects keep their keys' order, with whole-number keys first, or are
sorted for canonical text.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

SPACES = "\t\n\x0b\x0c\r                  　﻿"
_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")
#: A number that the writer would spell otherwise waits as a text between these marks.
_MARK = "\x00#"
_MARKED = re.compile(r'"\\u0000#([^"]*)"')


def number_text(x: float) -> str:
    """A double in the shortest decimal form: plain from 1e-6 up to 1e21, with an exponent beyond."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    sign, body = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, exponent = body.partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))  # of 0.ddd
    digits = digits.rstrip("0")
    if not digits:
        return "0"
    if len(digits) <= point <= 21:
        return sign + digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' if digits[1:] else ''}{digits[1:]}e{point - 1:+d}"


def _real(text: str) -> float | int | str:
    x = float(text)
    out = number_text(x)
    if out[-1] in "yN":  # beyond all doubles: no JSON number, so it becomes a text
        return out
    if "e" not in out and "." not in out:
        return int(out)
    return x if repr(x) == out else _MARK + out


def _whole(text: str) -> int | float | str:
    return int(text) if len(text) < 16 else _real(text)


def _refuse(name: str):
    raise ValueError(name)


def parse(text: str):
    """The value of a JSON text; ValueError if it isn't one (RecursionError for thousands of levels)."""
    return json.loads(text, parse_float=_real, parse_int=_whole, parse_constant=_refuse)


def is_number(x) -> bool:
    return (isinstance(x, (int, float)) and not isinstance(x, bool)) or (isinstance(x, str) and x.startswith(_MARK))


def _ordered(value, order):
    if isinstance(value, dict):
        keys = order(value)
        return {k: _ordered(value[k], order) for k in keys}
    return [_ordered(v, order) for v in value] if isinstance(value, list) else value


def _own(record: dict):
    """Keys in their order, those that are array indices first."""
    index = [k for k in record if _INDEX.fullmatch(k) and int(k) < 2**32 - 1]
    return sorted(index, key=int) + [k for k in record if k not in set(index)] if index else record


def _by_units(record: dict):
    """Keys by UTF-16 code units."""
    return sorted(record, key=lambda k: k.encode("utf-16-be", "surrogatepass"))


def _by_letters(record: dict):
    """Keys as a dictionary has them: marks, digits, letters whatever their case, then lower case first."""
    rank = lambda c: (0 if c == "_" else 1 if not c.isalnum() else 2 if c.isdigit() else 3, c.casefold())
    return sorted(record, key=lambda k: ([rank(c) for c in k], k.swapcase()))


ORDERS = {"own": _own, "units": _by_units, "letters": _by_letters}


def _clean(text: str) -> str:
    """Text that UTF-8 can hold: lone surrogates are replaced."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def write(value, order: str = "own") -> str:
    """The JSON text of a parsed value, without spaces."""
    if order == "own" and not isinstance(value, (dict, list)):
        text = json.dumps(value, ensure_ascii=False)
    else:
        text = json.dumps(_ordered(value, ORDERS[order]), ensure_ascii=False, separators=(",", ":"))
    if "\\u0000#" in text:
        text = _MARKED.sub(r"\1", text)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def tagged(value) -> tuple[str, str] | None:
    """(kind, text): s a string, n a number, b a boolean, o an object or a an array as JSON text; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "b", "true" if value else "false"
    if isinstance(value, str):
        return ("n", value[len(_MARK) :]) if value.startswith(_MARK) else ("s", _clean(value))
    if isinstance(value, (int, float)):
        return "n", str(value) if isinstance(value, int) else number_text(value)
    return "o" if isinstance(value, dict) else "a", write(value)


def tagged_field(value) -> tuple[str, str] | None:
    """As :func:`tagged`, but a string that looks like JSON is parsed; one that doesn't parse has kind x and its text."""
    if isinstance(value, str) and not value.startswith(_MARK):
        text = value.strip(SPACES)
        if text[:1] in ("{", "["):
            try:
                return tagged(parse(text))
            except (ValueError, RecursionError):
                return "x", _clean(value)
    return tagged(value)


_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_RADIX = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")


def _as_number(value) -> float | None:
    """The number that a value counts as; None for no number."""
    if isinstance(value, list):
        return 0.0 if not value or value == [None] else _as_number(value[0]) if len(value) == 1 and not isinstance(value[0], bool) else None
    if isinstance(value, dict) or value is None:
        return None
    if isinstance(value, str):
        text = tagged(value)[1].strip(SPACES)
        return 0.0 if not text else float(int(text, 0)) if _RADIX.fullmatch(text) else float(text) if _NUMBER.fullmatch(text) else None
    return float(value)


def tagged_count(value) -> tuple[str, str] | None:
    """(n, digits) of a value that counts as a whole number from 0 (below 2^63), (x, text) of others; None for null."""
    number = _as_number(value)
    if number is None or not 0 <= number < 2**63 or not number.is_integer():
        return value if value is None else ("x", tagged(value)[1])
    return "n", str(int(number))


def plain_text(value) -> str:
    """What a content says: strings as they are, the parts of arrays joined by spaces, an object's text or content, else its JSON."""
    if isinstance(value, list):
        return " ".join(t for t in map(plain_text, value) if t)
    if isinstance(value, dict):
        if isinstance(value.get("text"), str) and not is_number(value["text"]):
            return value["text"]
        return plain_text(value["content"]) if "content" in value else write(value)
    return "null" if value is None else tagged(value)[1]


#: Texts that are Python objects at a time; all others of a batch stay in Arrow.
_AT_ONCE = 64


def canonical_json(text: Column, order: str = "units") -> Column:
    """The key-sorted JSON text of a JSON text at any depth; a text that isn't JSON becomes a JSON string, null stays null.

    ``order``: ``units`` sorts keys by code units, ``letters`` as a dictionary does.
    """

    @F.arrow_udf(T.StringType())
    def canonical(column: pa.Array) -> pa.Array:
        done = []
        for at in range(0, len(column), _AT_ONCE):
            out = []
            for t in column[at : at + _AT_ONCE].to_pylist():
                if t is not None:
                    try:
                        t = write(parse(t), order)
                    except (ValueError, RecursionError):
                        t = write(t)
                out.append(t)
            done.append(pa.array(out, pa.string()))
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return canonical(text)
