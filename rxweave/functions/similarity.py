"""String similarities that Spark lacks, as Arrow-batched UDFs. Use them behind a blocking join only.

A null on either side gives null. Scores are 0..1 (gestalt) or 0..100 (the others).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all columns of a row at once in the bits of one integer."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    everything = (1 << len(b)) - 1
    free = everything
    for x in a:
        hit = free & places.get(x, 0)
        free = (free + hit | free - hit) & everything
    return len(b) - free.bit_count()


def _indel(a: str, b: str) -> float:
    """200 * longest common subsequence / (len(a) + len(b))."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _token_sort(a: str, b: str) -> float:
    return _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    one, two = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max([_indel(one, two)] + ([_indel(both, one), _indel(both, two)] if both else []))


def _partial(a: str, b: str) -> float:
    """The best indel score of the shorter text against any equally long stretch of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    return max(_indel(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def weighted_ratio(a: str, b: str) -> float:
    """Best of the plain, token-sorted, token-set and partial scores, the latter ones scaled down by length ratio."""
    if not a or not b:
        return 0.0
    plain = _indel(a, b)
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    if ratio < 1.5 and " " not in a and " " not in b:  # one token each: the token scores are the plain one
        return plain
    if ratio < 1.5:
        return max(plain, 0.95 * max(_token_sort(a, b), _token_set(a, b)))
    scale = 0.9 if ratio <= 8 else 0.6
    return max(plain, scale * _partial(a, b), scale * 0.95 * max(_token_sort(a, b), _token_set(a, b)))


def _over(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


#: Gestalt (Ratcliff-Obershelp) ratio; it is not symmetric.
gestalt = F.pandas_udf(_over(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()), DoubleType())
indel_ratio = F.pandas_udf(_over(_indel), DoubleType())


def gestalt_from(cutoff: float):
    """The gestalt ratio where it can reach the cutoff, else 0: cheap upper bounds spare most of the work."""

    def ratio(a: str, b: str) -> float:
        m = difflib.SequenceMatcher(None, a, b)
        return m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0

    return F.pandas_udf(_over(ratio), DoubleType())



#: Marked as not deterministic, else a filter on the score is pushed below the block and scores every pair that meets there.
wratio = F.pandas_udf(_over(weighted_ratio), DoubleType()).asNondeterministic()
