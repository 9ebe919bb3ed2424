"""String similarity and length costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Priors of link types, length model, and the normal tail approximation.
PRIORS = {(1, 1): 0.89, (1, 0): 0.005, (0, 1): 0.005, (2, 1): 0.0445, (1, 2): 0.0445, (2, 2): 0.011}
MEAN, VARIANCE, MAX_COST = 1.0, 6.8, 25.0
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_SCALE, TAIL_DENSITY = 0.2316419, 0.3989423


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, ignoring case."""
    a, b = F.lower(a), F.lower(b)
    shorter = F.least(F.length(a), F.length(b))
    steps = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def infixes(a: Column, b: Column) -> tuple[Column, Column]:
    """What is left of both strings between their common prefix and common suffix."""
    pre = common_prefix(a, b)
    suf = F.least(common_prefix(F.reverse(a), F.reverse(b)),
                  F.least(F.length(a), F.length(b)) - pre)
    return (F.substring(a, pre + 1, F.length(a) - pre - suf),
            F.substring(b, pre + 1, F.length(b) - pre - suf))


def letter_infixes(a: Column, b: Column) -> tuple[Column, Column]:
    """``infixes`` after every run of non-letters became one underscore."""
    def letters(c: Column) -> Column:
        return F.regexp_replace(c, r"[^\p{L}]+", "_")
    return infixes(letters(a), letters(b))


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence, one machine word operation per character (bit-parallel)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence; used on candidate pairs of names only."""
    return pd.Series([None if x is None or y is None else _lcs(x, y) for x, y in zip(a, b)], dtype="Int32")


def lcs_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, lcs_length(a, b) / longest).otherwise(F.lit(0.0))


def differences(a: str, b: str) -> list[tuple[str, str]]:
    """Pairs of differing stretches between the parts two strings share (see ``difference_pairs``)."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = (best[i + 1][j + 1] + 1 if a[i] == b[j]
                          else max(best[i + 1][j], best[i][j + 1]))
    out, i, j, left, right = [], 0, 0, "", ""
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            if left or right:
                out.append((left, right))
            left = right = ""
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            left, i = left + a[i], i + 1
        else:
            right, j = right + b[j], j + 1
    if left or right:
        out.append((left, right))
    return out


_DIFFERENCES = T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))


@F.pandas_udf(_DIFFERENCES)
def difference_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    """The differing stretches of two names along a longest common subsequence."""
    return pd.Series([[{"a": x, "b": y} for x, y in differences(s, t)] for s, t in zip(a, b)])


def length_cost(src: Column, trg: Column, mean: float = MEAN, variance: float = VARIANCE) -> Column:
    """Cost of linking ``src`` with ``trg`` characters: minus log of the two-sided normal tail."""
    average = (src + trg / mean) / 2
    z = F.abs(mean * src - trg) / F.sqrt(F.lit(variance) * average)
    t = 1 / (1 + F.lit(TAIL_SCALE) * z)
    poly = F.lit(TAIL[4])
    for factor in reversed(TAIL[:4]):
        poly = poly * t + F.lit(factor)
    both_tails = 2 * F.lit(TAIL_DENSITY) * F.exp(-z * z / 2) * poly * t
    # the tail is compared as 1 - (1 - tail), so that it vanishes where doubles do
    both_tails = 2 * (1 - (1 - both_tails / 2))
    return (F.when((src == 0) & (trg == 0), F.lit(0.0))
            .when(both_tails > 0, -F.log(both_tails)).otherwise(F.lit(MAX_COST)))
