"""Similarity primitives that Spark lacks: longest-common-subsequence ratio and FNV-1a, on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: bit-parallel over the characters of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    # the shorter length bounds the ratio: most pairs need no table
    return lcs_length(a, b) / max(len(a), len(b))


def lcs_ratio(a: Column, b: Column) -> Column:
    """LCS over the longer length; 0 if either is empty or null."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def fnv1a(c: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes as 16 hex digits."""

    @F.pandas_udf(T.StringType())
    def digest(s: pd.Series) -> pd.Series:
        data = [x.encode() for x in s.fillna("")]
        h = np.full(len(data), 0xCBF29CE484222325, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(max(map(len, data), default=0)):
                on = np.array([i < len(x) for x in data])
                byte = np.array([x[i] if i < len(x) else 0 for x in data], np.uint64)
                h = np.where(on, (h ^ byte) * np.uint64(0x100000001B3), h)
        return pd.Series([f"{int(x):016x}" for x in h])

    return digest(c)
