"""Words and their hashes, as JVM expressions.

A word is a longest run of letters and digits (Unicode) after lower-casing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """All words of a text in order; null for a null text."""
    return F.filter(F.split(F.lower(text), NOT_A_WORD), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the words; an empty array for a null, blank or wordless text."""
    hashed = F.array_sort(F.transform(F.array_distinct(words(text)), lambda w: F.xxhash64(w)))
    return F.coalesce(hashed, F.array().cast("array<bigint>"))
