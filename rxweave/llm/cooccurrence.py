"""Items that appear together: pair counts over baskets with blocks for huge baskets, and association scores.

Baskets of at most ``block`` items give their pairs directly. The items of a huge basket are split by hash into chunks
of about ``block`` items; every pair of chunks becomes a row of its own, so the products of one basket spread over
all tasks. Both kinds of pairs are counted together, with partial counts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialised, semi_join_checked

#: Fixed value: white space of any kind, as a character class of a Java regular expression.
SPACES = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}\x{FEFF}]"


def trimmed(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(value, f"^{SPACES}+|{SPACES}+$", "")


def basket_items(records: DataFrame, basket: str, items: str) -> DataFrame:
    """Distinct ``basket, item``: the entries lower-cased and trimmed; null and blank entries and null baskets are dropped."""
    entries = records.where(F.col(basket).isNotNull()).select(F.col(basket).alias("basket"), F.explode(items).alias("item"))
    return entries.select("basket", F.lower(trimmed(F.col("item"))).alias("item")).where("item != ''").distinct()


def _pairs_within(lists: DataFrame, items: str) -> DataFrame:
    return (
        lists.select(F.col(items).alias("l"), F.posexplode(items).alias("i", "x"))
        .where(F.col("i") < F.size("l") - 1)
        .select("x", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("y"))
    )


def pair_counts(entries: DataFrame, block: int = 64) -> DataFrame:
    """``a, b, together`` with ``a < b`` for every pair of items that share a basket.

    ``entries`` are distinct ``basket, item`` rows; extra columns are ignored. Nulls in either give no pair, baskets of
    one item none either; an empty table gives no rows.
    """
    entries = materialised(entries.select("basket", "item").where("basket is not null and item is not null"))
    sizes = entries.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    huge = materialised(sizes.where(F.col("n") > block).select("basket", F.ceil(F.col("n") / block).cast("int").alias("k")))
    ordinary = entries.join(huge.select("basket"), "basket", "left_anti").groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("l"))
    chunks = (
        semi_join_checked(entries, huge, ["basket"])
        .join(huge, "basket")
        .withColumn("c", F.pmod(F.xxhash64("item"), F.col("k")).cast("int"))
        .groupBy("basket", "k", "c")
        .agg(F.array_sort(F.collect_list("item")).alias("l"))
    )
    met = (
        chunks.select("basket", "c", "l", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("p"))
        .groupBy("basket", F.least("c", "p").alias("c1"), F.greatest("c", "p").alias("c2"))
        .agg(F.collect_list("l").alias("ls"))
    )
    inside = _pairs_within(met.where("c1 = c2").select(F.col("ls")[0].alias("l")), "l")
    across = (
        met.where("c1 < c2 and size(ls) = 2")
        .select(F.explode(F.col("ls")[0]).alias("x"), F.col("ls")[1].alias("l"))
        .select("x", F.explode("l").alias("y"))
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    )
    pairs = _pairs_within(ordinary, "l").unionByName(inside).unionByName(across)
    return pairs.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count(F.lit(1)).alias("together"))


def associations(entries: DataFrame, baskets: int, least: int = 1, block: int = 64) -> DataFrame:
    """Pairs with at least ``least`` shared baskets, with counts and association scores.

    ``baskets`` is the number of all baskets. Items in fewer than ``least`` baskets are left out before pairs are
    formed; as a pair cannot be more frequent than its rarer item, this loses nothing.

    Scores: ``lift`` (observed over expected), ``pmi`` and ``npmi`` (its logarithm, plain and scaled to -1..1),
    ``jaccard``, and ``g2`` (log-likelihood ratio of the fourfold table).
    """
    singles = materialised(entries.where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    kept = semi_join_checked(entries, singles, ["item"]) if least > 1 else entries
    counted = pair_counts(kept, block).where(F.col("together") >= least)
    joined = counted.join(singles.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(
        singles.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b"
    )
    total = F.lit(float(baskets))
    n11, na, nb = (F.col(c).cast("double") for c in ("together", "n_a", "n_b"))

    def term(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)

    lift = n11 * total / (na * nb)
    g2 = 2 * (
        term(n11, na * nb / total)
        + term(na - n11, na * (total - nb) / total)
        + term(nb - n11, (total - na) * nb / total)
        + term(total - na - nb + n11, (total - na) * (total - nb) / total)
    )
    npmi = F.when(n11 < total, F.ln(lift) / -F.ln(n11 / total)).otherwise(1.0)
    return joined.select(
        "a", "b", "together", "n_a", "n_b", lift.alias("lift"), F.ln(lift).alias("pmi"), npmi.alias("npmi"), (n11 / (na + nb - n11)).alias("jaccard"), g2.alias("g2")
    )
