"""Text expressions with ASCII word boundaries.

Java's ``\\b`` looks at Unicode letters; the rules here are defined over ASCII words, so
boundaries are spelled out as look-arounds.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WORD = "A-Za-z0-9_"
#: White space as ECMAScript's trim and \\s know it.
SPACES = "\t\n\x0b\x0c\r                  　﻿"


def words(alternation: str, ignore_case: bool = True) -> str:
    """A pattern for an alternation of phrases that begin and end with word characters."""
    return ("(?i)" if ignore_case else "") + f"(?<![{_WORD}])(?:{alternation})(?![{_WORD}])"


def phrases(items: list[str]) -> str:
    return "|".join(items)


def has(c: Column, items: list[str]) -> Column:
    return c.rlike(words(phrases(items)))


def count(c: Column, items: list[str]) -> Column:
    return F.regexp_count(c, F.lit(words(phrases(items)))).cast("long")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    return trim(c) == ""


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("long")


def clamp(c: Column) -> Column:
    """Rounded half up, then held between 0 and 100."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(100).cast("long"), round_half_up(c)))
