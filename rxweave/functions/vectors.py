"""Vector expressions on arrays: dot product, norm, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; null for a zero vector unless ``epsilon`` is added to the denominator."""
    return F.try_divide(dot(a, b), norm(a) * norm(b) + epsilon)


def hashed_trigrams(text: Column, size: int = 64) -> Column:
    """A vector of ``size`` numbers for a text: its padded 3-grams counted by hash, scaled to length one.

    Deterministic, so it can stand in for an encoder; a null text gives null, an empty one counts its padding.
    """
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    slots = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.pmod(F.xxhash64(F.substr(padded, i, F.lit(3))), F.lit(size)).cast("int"))
    count = lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(s, lambda x: x == k)).cast("double"))
    # one-element transforms bind the slots, then counts and length, to names: each is computed once
    counted = F.transform(F.transform(F.array(slots), count), lambda c: F.struct(c.alias("c"), norm(c).alias("n")))
    return F.when(text.isNotNull(), F.transform(counted, lambda x: F.transform(x["c"], lambda y: y / x["n"]))[0])
