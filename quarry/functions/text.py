"""Text functions: normal forms, roman numerals, and Indel similarity as vectorised Python functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


# white space of any script: a fixed set
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def normal(text: Column) -> Column:
    """Lower case, letters, digits, underscores and single spaces only (any script); null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{SPACE}]", ""), f"[{SPACE}]+", " "))


def roman(text: Column) -> Column:
    """The value of a canonical roman numeral, else null: each letter counts, less twice if a larger one follows."""
    t = F.lower(F.trim(text))
    value = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000).otherwise(0)
    v = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), value)
    follow = F.concat(F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(v, follow, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda a, x: a + x)
    return F.when((t != "") & t.rlike(ROMAN), total)


def word_share(a: Column, b: Column) -> Column:
    """The share of the first text's distinct words, split at blanks, that the second has; null if either is."""
    w = F.array_distinct(F.split(a, " "))
    return F.size(F.array_intersect(w, F.split(b, " "))) / F.size(w)


def indel(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b), the LCS by bit-parallel rows; two empty texts are equal."""
    if not a and not b:
        return 100.0
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & mask
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def best_window(a: str, b: str) -> float:
    """The best Indel similarity of the shorter text with any stretch of its length in the longer, cut stretches at the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n = len(a)
    return max(indel(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def _pairs(f, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(indel, a, b)


def _best_window(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(best_window, a, b)


def indel_similarity(a: Column | str, b: Column | str) -> Column:
    """Indel similarity, 0 to 100; null if either text is."""
    return F.pandas_udf(_indel, "double")(a, b)


def partial_similarity(a: Column | str, b: Column | str) -> Column:
    """The shorter text's best Indel similarity with a stretch of the longer; null if either text is."""
    return F.pandas_udf(_best_window, "double")(a, b)
