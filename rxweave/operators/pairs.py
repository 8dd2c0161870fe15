"""Pairs of items within a record, lookups in an interaction knowledge base, and matching of pair sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import name_key, pair_name


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by ``order``; the planner keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """Both names lower-cased and trimmed (null as empty), the smaller first."""
    x, y = (pair_name(c) for c in (a, b))
    return F.least(x, y), F.greatest(x, y)


def enumerate_pairs(items: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """``key, first, second, first_ord, second_ord`` for all items of a record, the earlier first.

    Equi-join on the record with an order residual, so it distributes by record; items without a key give no pair,
    records of one item none; repeated items keep their own positions.
    """
    rows = items.select(key, item, order).where(F.col(key).isNotNull())
    return (
        rows.select(key, F.col(item).alias("first"), F.col(order).alias("first_ord"))
        .join(rows.select(F.col(key).alias("_k"), F.col(item).alias("second"), F.col(order).alias("second_ord")), (F.col(key) == F.col("_k")) & (F.col("first_ord") < F.col("second_ord")))
        .drop("_k")
    )


def flatten_index(edges: DataFrame) -> DataFrame:
    """``src_key, key_kind, target, description, target_id, pos``: every edge under its lower-cased name and under its id.

    ``edges``: ``source, source_id, target, target_id, description, pos``; null or blank names and ids give no key.
    """
    keys = F.array(
        F.struct(name_key(F.col("source")).alias("k"), F.lit("name").alias("kind")),
        F.struct(name_key(F.col("source_id")).alias("k"), F.lit("id").alias("kind")),
    )
    out = edges.select(F.explode(keys).alias("e"), "target", "description", "target_id", "pos").where("e.k != ''")
    return out.select(F.col("e.k").alias("src_key"), F.col("e.kind").alias("key_kind"), "target", "description", "target_id", "pos")


def lookup(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Joins pairs (``a, b``) to the first edge from a to b, and to the first from b to a where there is none.

    Adds ``description, target_id, direction`` (``forward``, ``reverse`` or null). One aggregation brings the index to
    one edge per directed pair, the one with the smallest position, before both joins.
    """
    edges = index.where("key_kind = 'name'").groupBy("src_key", name_key(F.col("target")).alias("tgt_key")).agg(F.min_by(F.struct("description", "target_id"), "pos").alias("edge"))
    a, b = name_key(F.col("a")), name_key(F.col("b"))
    ahead = edges.select(F.col("src_key").alias("_s1"), F.col("tgt_key").alias("_t1"), F.col("edge").alias("_e1"))
    back = edges.select(F.col("src_key").alias("_s2"), F.col("tgt_key").alias("_t2"), F.col("edge").alias("_e2"))
    joined = pairs.join(ahead, (a == F.col("_s1")) & (b == F.col("_t1")), "left").join(back, (b == F.col("_s2")) & (a == F.col("_t2")), "left")
    hit = F.coalesce("_e1", "_e2")
    direction = F.when(F.col("_e1").isNotNull(), "forward").when(F.col("_e2").isNotNull(), "reverse")
    return joined.select(*pairs.columns, hit["description"].alias("description"), hit["target_id"].alias("target_id"), direction.alias("direction"))


def match_pairs(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Full outer match of two sets of labelled pairs (``key, a, b, severity, ord``).

    Pairs are unordered; the first of repeated pairs counts. ``outcome`` is ``tp``, ``fn`` (truth only) or ``fp``;
    ``severity_agrees`` is null unless both sides have the pair.
    """

    def distinct(rows: DataFrame, label: str) -> DataFrame:
        lo, hi = unordered(F.col("a"), F.col("b"))
        rows = rows.select(key, lo.alias("lo"), hi.alias("hi"), F.col("severity").alias(label), "ord")
        return rows.groupBy(key, "lo", "hi").agg(F.min_by(F.struct(label), "ord").alias("_v")).select(key, "lo", "hi", F.col(f"_v.{label}"), F.lit(True).alias(f"in_{label}"))

    both = distinct(truth, "true_severity").join(distinct(found, "found_severity"), [key, "lo", "hi"], "full_outer")
    outcome = F.when(F.col("in_true_severity").isNull(), "fp").when(F.col("in_found_severity").isNull(), "fn").otherwise("tp")
    agrees = F.when(outcome == "tp", F.col("true_severity").eqNullSafe(F.col("found_severity")))
    return both.select(key, "lo", "hi", "true_severity", "found_severity", outcome.alias("outcome"), agrees.alias("severity_agrees"))
