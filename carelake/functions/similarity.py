"""String similarity. Jaro has no built-in form and is an Arrow function; the rest are Column expressions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=1 << 17)
def jaro_of(a: str, b: str) -> float:
    """Names repeat, so a worker keeps the pairs that it has met last. Jaro similarity over bytes: characters match within half the longer length, less one; half the matches out of order count against it."""
    if a == b:
        return 1.0
    x, y = a.encode(), b.encode()
    if not x or not y:
        return 0.0
    reach = max(0, max(len(x), len(y)) // 2 - 1)
    free = bytearray(b"\x01" * len(y))
    left = bytearray()
    for k, c in enumerate(x):
        at = y.find(c, max(0, k - reach), k + reach + 1)
        while at >= 0 and not free[at]:
            at = y.find(c, at + 1, k + reach + 1)
        if at >= 0:
            free[at] = 0
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = bytes(c for c, f in zip(y, free, strict=True) if not f)
    swapped = sum(p != q for p, q in zip(left, right, strict=True)) / 2
    return (m / len(x) + m / len(y) + (m - swapped) / m) / 3


@F.pandas_udf(DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else jaro_of(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")


def jaro(a: Column, b: Column) -> Column:
    return _jaro(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro with a tenth of the rest for each of up to four equal first characters, whatever the Jaro score."""
    j = jaro(a, b)
    prefix = sum((F.when((F.length(a) >= k) & (F.length(b) >= k) & (F.left(a, F.lit(k)) == F.left(b, F.lit(k))), 1).otherwise(0) for k in range(1, 5)), F.lit(0))
    return j + prefix * 0.1 * (1 - j)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance in characters over the longer length; equal strings, empty ones too, have 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


# Consonants by sound.
SOUNDS = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}


def soundex(value: Column) -> Column:
    """First letter and three sounds. Vowels part equal sounds, H, W and Y don't; the first letter's own sound isn't repeated after it."""
    letters = F.regexp_replace(F.upper(value), "[^A-Z]", "")
    source = "".join(SOUNDS.values()) + "AEIOU"
    target = "".join(k * len(v) for k, v in SOUNDS.items()) + "00000"
    # H, W and Y go, each sound is a digit, vowels are 0; the first letter's digit takes part in joining equal neighbours
    coded = F.translate(F.concat(F.left(letters, F.lit(1)), F.regexp_replace(F.substring(letters, 2, 1 << 20), "[HWY]", "")), source, target)
    joined = F.regexp_replace(coded, "([0-9])\\1+", "$1")
    rest = F.regexp_replace(F.substring(joined, 2, 1 << 20), "0", "")
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.left(letters, F.lit(1)), rest), 4, "0"))


def words(value: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def token_overlap(query: Column, target: Column) -> Column:
    """Share of the query's words that the target has, whole (1) or as part of a word or the other way round (0.9)."""
    q, t = words(query), words(target)
    score = F.aggregate(q, F.lit(0.0), lambda s, w: s + F.when(F.array_contains(t, w), 1.0).when(F.exists(t, lambda u: F.contains(u, w) | F.contains(w, u)), 0.9).otherwise(0.0))
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(score / F.size(q))


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
