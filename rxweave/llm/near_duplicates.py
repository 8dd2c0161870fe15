"""Near-duplicate records: banded min-hash candidates, sequential Bayesian pruning, exact verification.

1. Records with the same set of words form one class; only one representative of a class goes on.
2. One pass over all representatives estimates how many pairs share a band key of 2, 3, ... min-hashes. The number of
   min-hashes in a band is the one with the least work, shuffled rows and compared pairs together; the number of bands
   follows from the chance to miss a pair.
3. Every representative gets that many band keys and a signature of one-bit min-hashes. Representatives that share a
   key are candidates. Rows are counted per key where they meet; a key with many rows is split into pairs of chunks.
   Signatures are compared batch by batch inside the join; after each batch a pair is dropped when the posterior chance
   that its similarity reaches the threshold is below a bound, set so that all batches together lose ``miss``.
4. The survivors are verified exactly on their word sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.words import word_hashes
from ..plans.session import checkpointed, materialised, semi_join_checked
from .minhash import least_matches, minima, posterior_cut, signatures

#: Bits compared after each batch: the first four batches travel with the band keys, the others are fetched for survivors.
BATCHES = (32, 64, 96, 128, 160, 192, 224, 256)
WORDS = ("s1", "s2", "s3", "s4")
#: Lengths of a band that are weighed against each other, counters of the estimate for each, and the pairs that take as
#: long to compare as one band row takes to shuffle, sort and count. Bands shorter than four would be cheaper for small
#: collections only, and their keys are shared by unlike records.
LENGTHS = tuple(range(4, 13))
COUNTERS = 1024
PAIRS_PER_ROW = 25


def with_sets(texts: DataFrame) -> DataFrame:
    """Adds the word set ``h`` and its 128-bit digest ``d1, d2``; records without a word are left out."""
    sets = texts.withColumn("h", word_hashes(F.col("text"))).where(F.size("h") > 0)
    return sets.withColumn("d1", F.xxhash64(F.lit(1), "h")).withColumn("d2", F.xxhash64(F.lit(2), "h"))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The flat hashes of a batch and where each record begins."""
    lists = batch.column("h")
    return lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()


def _probed(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, records = np.zeros((len(LENGTHS), COUNTERS), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            records += batch.num_rows
            flat, starts = _lists(batch)
            key = batch.column("salt").to_numpy().view(np.uint64).copy()
            for k, values in enumerate(minima(flat, starts, LENGTHS[-1], seed + 1), 1):
                key ^= values.astype(np.uint64)
                key *= np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
                if k in LENGTHS:
                    mixed = key * np.uint64(0x94D049BB133111EB)
                    sign = np.where(mixed >> np.uint64(63), 1, -1)
                    np.add.at(counters[k - LENGTHS[0]], ((mixed >> np.uint64(40)) % np.uint64(COUNTERS)).astype(np.int64), sign)
        if records:
            at, where = np.nonzero(counters)
            rows = np.append(np.int64(0), LENGTHS[0] + at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.astype(np.int32)), pa.array(np.append(0, where).astype(np.int32)), pa.array(np.append(records, counters[at, where]))], names=["rows", "counter", "value"]
            )

    return run


def pairs_per_band(sets: DataFrame, seed: int) -> tuple[int, dict[int, float]]:
    """Records, and for every length of a band about how many pairs of records share its key, over all records.

    Every key adds its sign to one of ``COUNTERS`` counters; the sum of their squares estimates the sum of the squared
    sizes of all keys, to within a few percent.
    """
    probe = sets.select(F.xxhash64("grp").alias("salt"), "h").mapInArrow(_probed(seed), "rows int, counter int, value bigint")
    sums = probe.groupBy("rows", "counter").agg(F.sum("value").alias("v"))
    got = {r["rows"]: r["s"] for r in sums.groupBy("rows").agg(F.sum(F.when(F.col("rows") == 0, F.col("v").cast("double")).otherwise(F.col("v").cast("double") ** 2)).alias("s")).collect()}
    records = int(got.get(0, 0))
    return records, {r: max(0.0, (got.get(r, 0.0) - records) / 2) for r in LENGTHS}


def bands_for(rows: int, threshold: float, miss: float) -> int:
    """Bands of so many min-hashes that lose a pair at the threshold with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def banding(records: int, pairs: dict[int, float], threshold: float, miss: float) -> tuple[int, int]:
    """Bands and rows of least work, when ``pairs`` of ``records`` records share a key of each length."""
    work = {rows: bands_for(rows, threshold, miss) * (records * PAIRS_PER_ROW + found) for rows, found in pairs.items()}
    rows = min(work, key=lambda r: (work[r], r))
    return bands_for(rows, threshold, miss), rows


def _sketched(bands: int, rows: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sketch = signatures(*_lists(batch), bands, rows, bits, seed)
            salt = batch.column("salt").to_numpy().view(np.uint64)
            keys ^= salt[:, None]
            offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            columns = [batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))]
            columns += [pa.array(sketch[:, k].copy().view(np.int64)) for k in range(bits // 64)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "keys", *WORDS])

    return run


def _survives(least: dict[int, int], first: int, last: int) -> Column:
    """The sequential test over the signature words ``first`` to ``last`` of a pair, cheapest batch first.

    The number of bits in which the earlier words differ is the column ``differing`` when ``first`` is not 0.
    """
    low = F.lit(0xFFFFFFFF).cast("bigint")
    before = F.lit(0) if first == 0 else F.col("differing")
    test = F.lit(True)
    for k in range(first, last):
        differ = F.col(f"a.{WORDS[k]}").bitwiseXOR(F.col(f"b.{WORDS[k]}"))
        half, full = 64 * k + 32, 64 * k + 64
        test = test & (before + F.bit_count(differ.bitwiseAND(low)) <= half - least[half])
        before = before + F.bit_count(differ)
        test = test & (before <= full - least[full])
    return test


def _candidates(sketched: DataFrame, least: dict[int, int], hot: int) -> DataFrame:
    """``a, b, differing`` of all pairs that share a key and pass the first two words of the test.

    All rows are shuffled by key once and counted there, exactly. Keys of 2 to ``hot`` rows are joined in place. A key
    with more is split: its rows fall into chunks of about ``hot`` by the hash of their id, and every pair of chunks
    gets a key of its own, so that no task sees more than two chunks of a hot key. Only rows of hot keys are
    shuffled again.
    """
    banded = sketched.select("id", "s1", "s2", F.explode("keys").alias("key")).where("key is not null")  # as the join asks, so that all branches share one shuffle
    counted = banded.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    first = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))

    def meeting(rows: DataFrame, *conditions: Column) -> DataFrame:
        on = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))
        for condition in conditions:
            on = on & condition
        joined = rows.alias("a").join(rows.alias("b").hint("merge"), on & _survives(least, 0, 2))
        return joined.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), first.alias("differing"))

    pairs = meeting(counted.where((F.col("n") > 1) & (F.col("n") <= hot)))
    # in one job with the rest, so that the first shuffle is written once and read by both
    split = counted.where(F.col("n") > hot).select("id", "s1", "s2", "key", F.ceil(F.col("n") / hot).cast("int").alias("k"))
    chunk = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    spread = split.select("id", "s1", "s2", "key", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("p"))
    chunks = spread.select("id", "s1", "s2", "c", "p", F.xxhash64("key", F.least("c", "p"), F.greatest("c", "p")).alias("key"))
    different = (F.col("a.c") != F.col("b.c")) | (F.col("a.c") == F.col("a.p"))
    return pairs.unionByName(meeting(chunks, different)).distinct()


def similar_pairs(
    texts: DataFrame, group: str = "source", threshold: float = 0.6, band_miss: float = 0.007, miss: float = 0.003, seed: int = 7, hot: int = 256, rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives at or above the threshold, and the membership of all records.

    ``texts``: one row per record with ``group, text_id, text``; ids are unique within a group; extra columns are
    ignored, whatever their names. Returns ``pairs(group, a, b, similarity)`` with ``a < b`` and
    ``members(group, text_id, rep)``.

    Nulls, empty and wordless texts are in neither result; a null group is a group of its own. Copies are members of one
    class and give no pair of their own. Ties need no order. Very long texts count with all their words. An empty table
    gives empty results.

    Chance to miss a pair: in the bands ``(1 - s**rows)**bands`` for similarity s, which is ``band_miss`` at most at the
    threshold itself, and at most ``miss`` in the Bayesian test, all batches together. ``hot``: rows from which a band
    key is split into chunk pairs. ``rows`` sets the length of a band instead of choosing it.
    """
    if texts.schema[group].dataType.simpleString() != "string":
        raise TypeError(f"{group} must be a string")
    named = texts.select(F.col(group).alias("grp"), F.col("text_id").alias("tid"), "text")
    sets = materialised(with_sets(named).select("grp", "tid", "h", "d1", "d2"))
    first = sets.groupBy("grp", "d1", "d2").agg(F.min("tid").alias("rep"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("grp", "d1", "d2")]
    classes = sets.select("grp", "tid", "d1", "d2").alias("s").join(first.alias("r"), same[0] & same[1] & same[2]).select("s.grp", "tid", "rep")
    classes = materialised(classes)
    own = classes.where("tid = rep").select(F.col("grp").alias("g"), F.col("tid").alias("t"))
    # one number per representative stands for (group, id) from here on
    reps = materialised(sets.join(own, F.col("grp").eqNullSafe(F.col("g")) & (F.col("tid") == F.col("t")), "left_semi").select(F.monotonically_increasing_id().alias("id"), "grp", "tid", "h"))
    records, shared_keys = pairs_per_band(reps, seed)
    bands, rows = banding(records, shared_keys, threshold, band_miss) if rows is None else (bands_for(rows, threshold, band_miss), rows)
    least = dict(zip(BATCHES, least_matches(threshold, BATCHES, posterior_cut(threshold, BATCHES, miss))))
    sketched = materialised(
        reps.select("id", F.xxhash64("grp").alias("salt"), "h").mapInArrow(_sketched(bands, rows, 64 * len(WORDS), seed), "id bigint, keys array<bigint>, " + ", ".join(f"{w} bigint" for w in WORDS))
    )
    met = _candidates(sketched, least, hot)
    rest = sketched.select("id", *WORDS[2:])
    found = (
        met.join(rest.alias("a"), F.col("a") == F.col("a.id"))
        .join(rest.alias("b"), (F.col("b") == F.col("b.id")) & _survives(least, 2, 4))
        .select(met.a, met.b)
    )
    found = checkpointed(found)
    ids = checkpointed(found.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    words = semi_join_checked(reps, ids, ["id"])
    left = words.select(F.col("id").alias("a"), F.col("grp").alias("ga"), F.col("tid").alias("ta"), F.col("h").alias("ha"))
    right = words.select(F.col("id").alias("b"), F.col("grp").alias("gb"), F.col("tid").alias("tb"), F.col("h").alias("hb"))
    pairs = (
        found.join(left, "a")
        .join(right, "b")
        .where(F.col("ga").eqNullSafe(F.col("gb")))
        .withColumn("shared", F.size(F.array_intersect("ha", "hb")))
        .withColumn("union", F.size("ha") + F.size("hb") - F.col("shared"))
        .where(F.col("shared") >= F.lit(threshold) * F.col("union"))
        .select(F.col("ga").alias(group), F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), (F.col("shared") / F.col("union")).alias("similarity"))
    )
    return pairs, classes.select(F.col("grp").alias(group), F.col("tid").alias("text_id"), "rep")


def expand_pairs(pairs: DataFrame, members: DataFrame, group: str = "source") -> DataFrame:
    """All pairs of different records: members of similar classes, and the copies within a class."""
    link = pairs.select(F.col(group).alias("g"), F.col("a").alias("rep_a"), F.col("b").alias("rep_b"))
    m = members.select(F.col(group).alias("g"), F.col("text_id").alias("t"), "rep")
    x, y = (m.select(F.col("g").alias(f"g{s}"), F.col("t").alias(s), F.col("rep").alias(f"r{s}")) for s in "xy")
    across = link.join(x, F.col("g").eqNullSafe(F.col("gx")) & (F.col("rep_a") == F.col("rx"))).join(y, F.col("g").eqNullSafe(F.col("gy")) & (F.col("rep_b") == F.col("ry"))).select("x", "y")
    within = x.join(y, F.col("gx").eqNullSafe(F.col("gy")) & (F.col("rx") == F.col("ry")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("text_id_a"), F.greatest("x", "y").alias("text_id_b"))
