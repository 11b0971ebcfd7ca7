"""Text functions: normal forms, tokens, similarity ratios."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct (key, token) rows of a name's lower-cased blank-separated tokens."""
    return df.select(key, F.explode(F.array_distinct(F.split(F.lower(name), " "))).alias("token"))


def normal(s: str | None) -> str:
    """Compatibility form without accents, lower case, trimmed; null gives the empty text."""
    if s is None:
        return ""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().strip()


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


@cache
def _letters() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that become one other, or none, as two texts for ``translate``; and letters that become several ASCII letters."""
    one, none, several = [], [], []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) == "Cn":
            continue
        plain = _plain(c)
        if plain == "":
            none.append(c)
        elif len(plain) == 1 and plain != c:
            one.append((c, plain))
        elif len(plain) > 1 and plain.isascii() and plain.isalpha() and unicodedata.category(c)[0] == "L":
            several.append((c, plain))
    return "".join(c for c, _ in one) + "".join(none), "".join(p for _, p in one), tuple(several)


#: White space that compatibility forms don't turn into a blank.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"


def normalise(c: Column) -> Column:
    """:func:`normal` as an expression: each character becomes its plain form.

    Letters whose plain form is several ASCII letters (ligatures, digraphs) are
    spelt out; other characters that would become several, such as syllables
    of Hangul or fractions, stay as they are.
    """
    old, new, several = _letters()
    found = F.coalesce(c, F.lit(""))
    # Few names have one of these, so one search spares the replacements.
    spelt = found
    for char, plain in several:
        spelt = F.replace(spelt, F.lit(char), F.lit(plain))
    rare = found.rlike("[" + "".join(char for char, _ in several) + "]")
    return F.btrim(F.lower(F.translate(F.when(rare, spelt).otherwise(found), old, new)), F.lit(SPACES))


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity from 0 to 100; two empty texts are alike."""
    return 200.0 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of its length in the longer, cut windows at the ends too."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows)


@F.pandas_udf(T.DoubleType())
def token_sort_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def leading_int(c: str) -> Column:
    """The number a text starts with, or null."""
    return F.nullif(F.regexp_extract(c, "^(\\d+)", 1), F.lit("")).try_cast("int")


def season_before(season: Column) -> Column:
    """'2020-21' -> '2019-20'."""
    year = F.substring(season, 1, 4).cast("int") - 1
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def shortened(text: Column, most: int) -> Column:
    """A text of at most so many characters; a longer one ends in an ellipsis, which counts as one."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…")))


def shown_at(ts: Column, zone: str, pattern: str = "EEE d MMM, HH:mm") -> Column:
    """A UTC time as text in a display zone, summer time and all."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")), pattern)
