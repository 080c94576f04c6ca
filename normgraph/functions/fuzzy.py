"""Indel similarity, 200 * LCS / (|a| + |b|), by bit-parallel longest common subsequences, as Arrow UDFs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters of a text from which on its windows are looked at together.
LONG = 256


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _lcs(masks: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * _lcs(_masks(a), len(a), b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against the windows of its length in the longer, with the shorter windows at both ends. Windows
    whose common letters alone cannot beat the best are not aligned."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0
    if len(b) > LONG:
        return _partial_long(a, b)
    masks, best = _masks(a), 0.0
    need, have, common = Counter(a), Counter(), 0
    for end in range(1, len(b) + n):
        if end <= len(b):
            c = b[end - 1]
            have[c] += 1
            common += have[c] <= need[c]
        if end > n:
            c = b[end - n - 1]
            common -= have[c] <= need[c]
            have[c] -= 1
        window = b[max(0, end - n) : end]
        if 200 * common / (n + len(window)) > best:
            best = max(best, 200 * _lcs(masks, n, window) / (n + len(window)))
    if n == len(b):
        other = partial_ratio_windows(b, a)
        best = max(best, other)
    return best


def _partial_long(a: str, b: str) -> float:
    """partial_ratio() of a against a longer b: the windows' letters in common are counted at once, and windows are aligned from the most promising
    on until none of the rest can beat the best."""
    n, m = len(a), len(b)
    points = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.arange(1, m + n)
    low, high = np.maximum(0, ends - n), np.minimum(ends, m)
    common = np.zeros(len(ends), np.int64)
    for letter, need in Counter(a).items():
        seen = np.concatenate([[0], np.cumsum(points == ord(letter))])
        common += np.minimum(seen[high] - seen[low], need)
    bound = 200 * common / (n + high - low)
    masks, best = _masks(a), 0.0
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] <= best:
            break
        best = max(best, 200 * _lcs(masks, n, b[low[i] : high[i]]) / (n + int(high[i] - low[i])))
    return best


def partial_ratio_windows(a: str, b: str) -> float:
    """The same for strings of one length, seen from the other: windows of b against a."""
    masks, n = _masks(a), len(a)
    return max(200 * _lcs(masks, n, b[max(0, e - n) : e]) / (n + len(b[max(0, e - n) : e])) for e in range(1, len(b) + n))


@F.pandas_udf(DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _sorted(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def partial_ratio_column(a: Column, b: Column) -> Column:
    return _partial(a, b)


def token_sort_ratio_column(a: Column, b: Column) -> Column:
    return _sorted(a, b)


def length_bound(a: Column, b: Column) -> Column:
    """No ratio is above this; cheap enough to filter before the UDF runs."""
    return 200 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))
