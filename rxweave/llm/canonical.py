"""Mapping free entries to a reference list: n-gram inverted index, weighted cosine, threshold and margin.

1. Distinct values and entries are normalised to keys.
2. A key is the set of its character n-grams. A gram weighs as its inverse document frequency in the list. A gram that
   no entry has, the mark of a slip, weighs as little as a gram that every entry has, so that slips cost little.
3. The entries' grams are the inverted lists, a table. The values' grams are joined with it and the products are summed
   per value and entry: only entries that share a gram are ever scored.
4. The best target is accepted above a threshold and with a margin over the next one.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import materialised, spread

#: Rows up to which the inverted lists are broadcast, each of about 50 bytes; beyond it they are joined by a shuffle.
MOST_POSTINGS = 1_000_000

# Words around a drug name that are not part of it.
FORMS = {
    "tab", "tabs", "tablet", "tablets", "cap", "caps", "capsule", "capsules", "inj", "injection", "syp", "syr", "syrup", "susp",
    "suspension", "drop", "drops", "cream", "gel", "oint", "ointment", "t", "c", "rx", "generic", "brand", "forte", "plus", "sr",
    "xr", "er", "cr", "mr", "la", "xl", "od", "bd", "tds", "qid", "hs", "sos", "stat", "prn", "hydrochloride", "hcl", "sodium",
    "potassium", "calcium", "maleate", "phosphate", "sulfate", "sulphate", "tartrate", "citrate", "acetate", "besylate", "mesylate",
}
UNITS = "mg|mcg|ug|µg|g|ml|iu|units?|%"
DOSE = re.compile(rf"\d+(?:[.,]\d+)?\s*(?:{UNITS})(?![^\W\d_])", re.I)
ALONE = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
# Signs that scanners take for one another, both sides folded to the same sign.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "5": "s", "@": "a", "$": "s", "8": "b", "6": "b", "9": "g"})


def normalise(value: str) -> str:
    """Lower case without accents, invisible signs, doses, dosage forms, salts and separators, lookalikes folded."""
    text = unicodedata.normalize("NFKC", value)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = DOSE.sub(" ", text)
    text = ALONE.sub(" ", text).lower()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    parts = [p for p in re.split(r"[^\w@|!$]+|_", text) if p and p not in FORMS]
    return "".join(parts).translate(LOOKALIKE).replace("rn", "m")


def grams(key: Column) -> Column:
    """2-grams and 3-grams of the padded key, pairs of signs one apart, 3-grams with their signs sorted, and the two ends
    together: pairs and sorted grams outlast a swap of neighbours, and slips are rarest at the ends. Each gram once."""
    padded = F.concat(F.lit("^"), key, F.lit("$"))
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.length(key) + 3 - n, F.lit(1)))
    plain = lambda n: F.transform(starts(n), lambda i: F.substr(padded, i, F.lit(n)))
    apart = F.transform(starts(3), lambda i: F.concat(F.substr(padded, i, F.lit(1)), F.lit("_"), F.substr(padded, i + 2, F.lit(1))))
    ordered = F.transform(plain(3), lambda g: F.concat(F.lit("~"), F.array_join(F.array_sort(F.split(g, "")), "")))
    ends = F.array(F.concat(F.lit("|"), F.substr(key, F.lit(1), F.lit(2)), F.right(key, F.lit(2))))
    return F.array_distinct(F.concat(plain(2), plain(3), apart, ordered, ends))


def literal_values(text: str | None) -> list[str]:
    """The strings of a list or tuple written as Python or JSON text; anything else is taken apart by its quotes."""
    if text is None or not text.strip():
        return []
    for read in (ast.literal_eval, json.loads):
        try:
            got = read(text.strip())
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        got = got if isinstance(got, (list, tuple, set)) else [got]
        return [x for x in got if isinstance(x, str)]
    return [a or b for a, b in re.findall(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"", text)]


def _keys(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([normalise(x) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "key"])

    return run


def postings(reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted lists of ``reference`` (``target bigint, surface string``): ``gram, target, entry, weight``, vectors
    scaled to length one; and ``gram, idf`` of every gram. ``gram`` is a 64-bit hash and ``entry`` a number. Surfaces
    that are null or normalise to nothing are left out."""
    surfaces = reference.select(F.col("target").cast("bigint").alias("target"), "surface").dropna().distinct()
    entries = materialised(surfaces.mapInArrow(_keys("surface"), "target bigint, surface string, key string").where("key != ''").select("target", "key").distinct())
    keys = materialised(entries.select("key").distinct().select("key", F.monotonically_increasing_id().alias("entry")))
    number = keys.count()
    listed = keys.select("entry", F.explode(grams(F.col("key"))).alias("g")).select("entry", F.xxhash64("g").alias("gram"))
    idf = materialised(listed.groupBy("gram").agg((F.ln((1.0 + number) / (1.0 + F.count(F.lit(1)))) + 1).alias("idf")))
    weighed = listed.join(idf, "gram")
    norms = weighed.groupBy("entry").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm"))
    lists = weighed.join(norms, "entry").join(keys, "entry").join(entries, "key").select("gram", "target", "entry", (F.col("idf") / F.col("norm")).alias("weight"))
    return materialised(lists), idf


def map_values(values: DataFrame, reference: DataFrame, threshold: float = 0.49, margin: float = 0.005, reported: float | None = None) -> DataFrame:
    """``entered, target, score, next_score, first`` for every distinct ``entered`` value; ``target`` is null if none is
    close enough, ``first`` is the closest one all the same.

    ``reference``: rows ``target bigint, surface string``; extra columns of either table are ignored. A value is accepted
    when its best target has a cosine of at least ``threshold`` and leads any other target by ``margin``. Targets below
    ``reported`` (by default ``threshold - margin``, beyond which none can matter) are left out of ``first``,
    ``score`` and ``next_score``, which then are null, 0 and 0.

    Null values are dropped; blank ones, or values that normalise to nothing, have no target. Entries of the list that
    are null or normalise to nothing are ignored. Equal scores go to the smaller target, and fail the margin. An empty
    list leaves every value without a target. Very long values count with all their grams.
    """
    lists, idf = postings(reference)
    near = F.broadcast if lists.count() <= MOST_POSTINGS else (lambda df: df)
    least = threshold - margin if reported is None else reported
    distinct = values.select("entered").where("entered is not null").distinct()
    keyed = materialised(distinct.mapInArrow(_keys("entered"), "entered string, key string"))
    # spread by key before anything else: all that follows up to the best targets stays within these partitions
    keys = spread(keyed.select("key").where("key != ''"), "key").distinct().select("key", grams(F.col("key")).alias("grams"))
    split = keys.select("key", F.size("grams").alias("size"), F.explode("grams").alias("g"))
    seen = split.select("key", "size", F.xxhash64("g").alias("gram")).join(near(idf), "gram")
    # a gram outside the list has the weight 1
    norms = seen.groupBy("key").agg(F.sqrt(F.sum(F.col("idf") ** 2) + F.max("size") - F.count(F.lit(1))).alias("norm"))
    dots = seen.join(near(lists), "gram").groupBy("key", "entry", "target").agg(F.sum(F.col("idf") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, "key").withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= least).groupBy("key", "target").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.round("score", 12)), "target"))
    two = scores.withColumn("place", place).where("place <= 2")
    is_first = F.col("place") == 1
    best = two.groupBy("key").agg(F.max(F.when(is_first, F.col("target"))).alias("first"), F.max(F.when(is_first, F.col("score"))).alias("score"), F.max(F.when(~is_first, F.col("score"))).alias("next_score"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = keyed.join(best, "key", "left").select("entered", "first", zero("score").alias("score"), zero("next_score").alias("next_score"))
    accepted = (F.col("score") >= threshold) & (F.col("score") - F.col("next_score") >= margin)
    return joined.select("entered", F.when(accepted, F.col("first")).alias("target"), "score", "next_score", "first")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [literal_values(x) for x in batch.column("written").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("written"), pa.array(lists, pa.list_(pa.string()))], names=["written", "values"])


def parse_lists(rows: DataFrame) -> DataFrame:
    """``written, values`` for every distinct ``written`` text of a list; a null gives no row."""
    return rows.select("written").where("written is not null").distinct().mapInArrow(_parsed, "written string, values array<string>")
