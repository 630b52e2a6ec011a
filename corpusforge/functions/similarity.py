"""Similarity of strings and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    hits: list[str] = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [y for y, f in zip(b, free) if not f]
    m, swaps = len(hits), sum(x != y for x, y in zip(hits, other)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    if j <= 0.7:
        return j
    n = 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return j + 0.1 * n * (1 - j)


@F.pandas_udf(T.DoubleType())
def jaro_col(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_col(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix in characters."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.array_max(same)).cast("int")


def combined_similarity(a: Column, b: Column, winkler: bool = False) -> Column:
    """0.40 Jaro + 0.35 edit similarity + 0.25 common prefix, on lower case; 1 if equal without case."""
    x, y = F.lower(a), F.lower(b)
    j = (jaro_winkler_col if winkler else jaro_col)(x, y)
    longest = F.greatest(F.length(x), F.length(y))
    mix = 0.40 * j + 0.35 * edit_similarity(x, y) + 0.25 * F.when(longest == 0, F.lit(0.0)).otherwise(common_prefix(x, y) / longest)
    return F.when(x == y, F.lit(1.0)).otherwise(mix)


def _dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; 1 if a vector has no length."""
    na, nb = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    d = 1 - _dot(a, b) / F.nullif(na * nb, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce(d, F.lit(1.0))))


def hybrid_distance(text_a: Column, text_b: Column, vec_a: Column, vec_b: Column, text_weight: float = 0.60) -> Column:
    return text_weight * (1 - combined_similarity(text_a, text_b)) + (1 - text_weight) * cosine_distance(vec_a, vec_b)
