"""Similarity join of strings by the pigeonhole principle.

A string with at most k errors leaves at least one of k + 1 segments of the other untouched. Every indexed string is cut
into k + 1 segments; a probe looks up those of its substrings that can be segment i of a string of length l, shifted by
no more than the errors allow (multi-match-aware selection), in an inverted index that is an equi-join on
(length, segment number, text). Candidates are verified by banded edit distance in the JVM. k depends on the length of
the indexed string.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: errors allowed at most
MOST = 3


def allowed(length: int) -> int:
    """Errors allowed for an indexed string: none below 4 letters, 1 below 7, 2 below 18, else 3."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 18 else 3


def _allowed(length: Column) -> Column:
    return F.when(length < 4, 0).when(length < 7, 1).when(length < 18, 2).otherwise(3)


def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 segments, the longer ones last."""
    base, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = base + (i >= k + 1 - more)
        out.append((at, n))
        at += n
    return out


def index_keys(s: str) -> list[str]:
    n = len(s)
    return [f"{n}.{i}.{s[p : p + m]}" for i, (p, m) in enumerate(cuts(n, allowed(n)))] if n else []


def probe_keys(s: str) -> list[str]:
    """Keys of every indexed string within its allowed errors of s."""
    return list(dict.fromkeys([head + s[at : at + m] for head, m, where in _windows(len(s)) for at in where]))


@lru_cache(maxsize=1 << 10)
def _windows(n: int) -> list[tuple[str, int, range]]:
    """What is looked up of a string of n letters: how a key begins, the length of its segment, where that can begin."""
    out = []
    for length in range(max(1, n - 3), n + 4):
        k, d = allowed(length), n - length
        if abs(d) > k:
            continue
        for i, (p, m) in enumerate(cuts(length, k)):
            lo = max(0, p - i, p + d - (k - i))
            hi = min(n - m, p + i, p + d + (k - i))
            if lo <= hi:
                out.append((f"{length}.{i}.", m, range(lo, hi + 1)))
    return out


def _keys(make: Callable[[str], list[str]], text: str) -> Column:
    """Made where it is used: a Python worker that imports this module has no session to parse the type with."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: make(x or ""))

    return F.explode(F.pandas_udf(run, T.ArrayType(T.StringType()))(text))


def similar(indexed: DataFrame, probes: DataFrame, text: str = "s", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of indexed and probes (columns other than ``text`` must not clash) whose texts are within the edits allowed
    for the indexed one, with ``edits``, equal in the columns ``by``. Null and empty texts match nothing. Pairs may repeat
    if their rows do."""
    i = indexed.withColumn("_k", _keys(index_keys, text)).withColumnRenamed(text, "_a").withColumn("_k", F.xxhash64("_k", *by))
    p = probes.withColumn("_k", _keys(probe_keys, text)).withColumnRenamed(text, "_b").withColumn("_k", F.xxhash64("_k", *by))
    limit = _allowed(F.length("_a"))
    # the threshold of levenshtein() is a constant: the widest band, then the one of this length
    near = i.join(p, ["_k", *by]).withColumn("edits", F.levenshtein("_a", "_b", MOST)).where((F.col("edits") >= 0) & (F.col("edits") <= limit))
    return near.drop("_k", "_a", "_b")
