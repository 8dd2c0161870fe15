"""From texts to reports: mentions, entities, pairs, interactions, roll-up - one lazy plan for any number of texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as S
from ..functions import text as T
from ..operators import matching as X
from ..operators import pairs as P
from ..operators import scan


@dataclass
class Knowledge:
    """``names``: ``name``; ``synonyms``: ``alias, concepts``; ``index``: see ``operators.pairs.flatten_index``."""

    names: DataFrame
    synonyms: DataFrame
    index: DataFrame


def mentions(texts: DataFrame, known: Knowledge) -> DataFrame:
    """``rx_id, ord, name, confidence, method`` of all names found: by the dictionary, and for texts without any such hit
    by correcting their candidates within two edits, a tie abstaining."""
    words = texts.select("rx_id", scan.tokens(T.glued_presplit(F.col("text"))).alias("ws"))
    keys = known.names.select(F.lower("name").alias("key")).unionByName(known.synonyms.select(F.lower("alias").alias("key"))).distinct()
    exact = scan.dictionary(words, "rx_id", "ws", keys).select("rx_id", F.col("at").alias("ord"), F.col("key").alias("mention"), F.lit(1.0).alias("confidence"), F.lit("dictionary").alias("method"))
    rest = words.join(exact.select("rx_id").distinct(), "rx_id", "left_anti")
    tried = scan.candidates(rest, "rx_id", "ws", 600).where((F.col("n") == 1) & (F.length("candidate") >= 5))
    near = X.corrected(tried.select(F.col("candidate").alias("word")).distinct(), keys.select(F.col("key").alias("name")))
    fuzzy = tried.join(near, F.col("candidate") == F.col("word")).select("rx_id", F.col("at").alias("ord"), F.col("name").alias("mention"), F.greatest(F.lit(0.75), 1 - 0.08 * F.col("distance")).alias("confidence"), F.lit("corrected").alias("method"))
    found = exact.unionByName(fuzzy)
    resolved = found.join(known.synonyms.select(F.lower("alias").alias("mention"), "concepts"), "mention", "left")
    out = resolved.select("rx_id", "ord", F.explode(F.coalesce("concepts", F.array("mention"))).alias("name"), "confidence", "method")
    return out.where(T.valid_entity(F.col("name")))


def entities(found: DataFrame) -> DataFrame:
    """Each name of a text once, at its first place, with its best confidence."""
    return found.groupBy("rx_id", "name").agg(F.min("ord").alias("ord"), F.max("confidence").alias("confidence"), F.min("method").alias("method"))


def interactions(ents: DataFrame, index: DataFrame, second_opinion: Column | None = None) -> DataFrame:
    """``rx_id, a, b, description, direction, severity, risk`` of all pairs that the knowledge base has.

    ``second_opinion``: an expression over these columns for an outside grade; the higher one of both counts.
    """
    pairs = P.enumerate_pairs(ents, "rx_id", "name", "ord").select("rx_id", F.col("first").alias("a"), F.col("second").alias("b"))
    hits = P.lookup(pairs, index).where("direction is not null")
    own = S.keyword_severity(F.col("description"))
    final = S.safety_first(own, second_opinion) if second_opinion is not None else own
    return hits.withColumn("severity", final).withColumn("risk", S.risk_score(F.col("severity")))


def report(texts: DataFrame, ents: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per text: names, pairs, highest severity and risk, confidence statistics, flags."""
    per_name = ents.groupBy("rx_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "name", "confidence"))).alias("e"), F.avg("confidence").alias("mean_confidence"), F.stddev_pop("confidence").alias("std"), F.count_if(F.col("confidence") < 0.7).alias("low"),
    )
    per_pair = hits.groupBy("rx_id").agg(F.count(F.lit(1)).alias("n_interactions"), S.max_label(F.col("severity")).alias("worst"), F.max("risk").alias("risk"), F.bool_or(F.col("severity") == "Severe").alias("severe"))
    joined = texts.select("rx_id").join(per_name, "rx_id", "left").join(per_pair, "rx_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    names = F.coalesce(F.col("e.name"), F.array().cast("array<string>"))
    return joined.select(
        "rx_id", names.alias("medicines"), zero("n_interactions").alias("n_interactions"), F.coalesce("worst", F.lit(S.NO_INTERACTION)).alias("max_severity"), F.coalesce("risk", F.lit(S.RISK[S.NO_INTERACTION])).alias("risk"),
        F.round(zero("mean_confidence"), 6).alias("confidence"), F.round(1 - F.least(zero("std"), F.lit(1.0)), 6).alias("certainty"),
        (zero("n_interactions") > 0).alias("has_concern"), F.coalesce("severe", F.lit(False)).alias("has_severe"), ((zero("low") > 0) | (F.size(names) == 0)).alias("needs_review"),
    )


def analyze(texts: DataFrame, known: Knowledge, second_opinion: Column | None = None) -> DataFrame:
    """``texts``: ``rx_id, text``, ids unique; extra columns are ignored. A null or empty text gives a report without names."""
    texts = texts.select("rx_id", "text")
    ents = entities(mentions(texts, known))
    return report(texts, ents, interactions(ents, known.index, second_opinion))
