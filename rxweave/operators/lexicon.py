"""Building a name lexicon: aliases, upserts, votes over sources, ingredients, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .pairs import first_of_each

# Salt words that may be dropped from the end of an ingredient.
SALTS = (
    "hydrochloride", "hcl", "potassium", "sodium", "succinate", "tartrate", "dihydrate", "hydrate", "mesylate", "maleate",
    "fumarate", "citrate", "sulphate", "sulfate", "phosphate", "besylate", "arginine", "trometamol", "tromethamine", "calcium",
    "magnesium", "strontium", "medoxomil", "pamoate", "embonate", "valerate", "butyrate", "propionate", "acetate", "stearate",
    "palmitate", "ascorbate", "gluconate", "syclate", "toxilate", "di", "bis", "tert", "as", "in",
)


def alias_pool(aliases: DataFrame, generics: DataFrame) -> DataFrame:
    """``alias, concept``: usable aliases, one concept each (the smallest), without those that equal a generic name."""
    clean = aliases.select(T.name_key(F.col("alias")).alias("alias"), "concept").where(~T.junk_alias(F.col("alias")))
    return clean.join(generics.select(F.col("name").alias("alias")), "alias", "left_anti").groupBy("alias").agg(F.min("concept").alias("concept"))


def upsert(base: DataFrame, over: DataFrame) -> DataFrame:
    """``alias, concepts, source``: rows of both, those of ``over`` where both have an alias."""
    b = base.select("alias", F.col("concepts").alias("_b"))
    o = over.select("alias", F.col("concepts").alias("_o"))
    both = b.join(o, "alias", "full_outer")
    return both.select("alias", F.coalesce("_o", "_b").alias("concepts"), F.when(F.col("_o").isNotNull(), "over").otherwise("base").alias("source"))


def resolve(mentions: DataFrame, synonyms: DataFrame, clean: Callable[[Column], Column] = T.clean_mention) -> DataFrame:
    """``mention, name, step``: all concepts of the raw mention, else of the cleaned one, else the mention itself.

    Names of one or two letters that are stopwords are never resolved.
    """
    raw, cleaned = T.name_key(F.col("mention")), clean(F.col("mention"))
    keyed = mentions.select("mention", raw.alias("raw"), cleaned.alias("cleaned"))
    s1 = synonyms.select(F.col("alias").alias("raw"), F.col("concepts").alias("_c1"))
    s2 = synonyms.select(F.col("alias").alias("cleaned"), F.col("concepts").alias("_c2"))
    short = (F.length("raw") <= 2) & F.col("raw").isin(*T.STOPWORDS)
    joined = keyed.join(s1, "raw", "left").join(s2, "cleaned", "left")
    picked = F.when(short, F.array("raw")).otherwise(F.coalesce("_c1", "_c2", F.array("raw")))
    step = F.when(short, "stopword").when(F.col("_c1").isNotNull(), "raw").when(F.col("_c2").isNotNull(), "cleaned").otherwise("itself")
    return joined.select("mention", F.explode(picked).alias("name"), step.alias("step"))


def vote(facts: DataFrame, key: str, source: str, ingredients: str, heavy: str, weight: int = 3) -> DataFrame:
    """The ingredients that win the vote of each key, with ``votes, score, rows, verified``.

    A row counts ``weight`` from the source ``heavy``, else one. Among lists with at least half of the top score the
    longest wins, then the higher score, then the smaller list. Verified: two rows or more and at least half of them.
    """
    w = F.when(F.col(source) == heavy, weight).otherwise(1)
    counts = facts.groupBy(key, ingredients).agg(F.count(F.lit(1)).alias("votes"), F.sum(w).alias("score"))
    total = Window.partitionBy(key)
    rated = counts.select("*", F.sum("votes").over(total).alias("rows"), F.max("score").over(total).alias("top")).where(F.col("score") * 2 >= F.col("top"))
    won = first_of_each(rated, [key], [F.desc(F.size(ingredients)), F.desc("score"), F.col(ingredients)])
    verified = (F.col("rows") >= 2) & (F.col("votes") >= F.greatest(F.lit(2), F.floor(F.col("rows") / 2)))
    return won.select(key, ingredients, "votes", "score", "rows", verified.alias("verified"))


def ingredient_candidates(raw: Column) -> Column:
    """Spellings under which an ingredient may be known, in order: outer text, with its bracket, hyphen and blank forms, and
    each without salts at its end."""
    s = T.squeezed(F.lower(F.coalesce(raw, F.lit(""))))
    tidy = lambda c: F.btrim(T.squeezed(F.regexp_replace(c, r"[^a-z0-9\s\-/]", " ")), F.lit(" -/"))
    inner = tidy(F.regexp_extract(s, r"\(([^)]+)\)", 1))
    outer = tidy(F.regexp_replace(s, r"\s*\([^)]*\)\s*", " "))
    named = (inner != "") & ~inner.rlike(r"\d")
    base = F.filter(F.array(outer, F.when(named, F.concat_ws(" ", outer, inner)), F.when(named, F.concat_ws(" ", inner, outer))), lambda c: c.isNotNull() & (c != ""))
    hyphens = F.flatten(F.transform(base, lambda c: F.filter(F.array(F.replace(c, F.lit(" "), F.lit("-")), F.replace(c, F.lit("-"), F.lit(" "))), lambda v: v != c)))
    spellings = F.array_distinct(F.concat(base, hyphens))
    bare = lambda c: F.regexp_replace(c, rf"( ({'|'.join(SALTS)}))+$", "")
    return F.array_distinct(F.flatten(F.transform(spellings, lambda c: F.array(c, bare(c)))))


def normalize_ingredients(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``raw, ingredient``: the first known spelling of each raw ingredient; null if none is known."""
    tries = rows.select("raw", F.posexplode(ingredient_candidates(F.col("raw"))).alias("pos", "name"))
    hits = tries.join(known.select("name", F.col("canonical")), "name").groupBy("raw").agg(F.min_by("canonical", "pos").alias("ingredient"))
    return rows.select("raw").distinct().join(hits, "raw", "left")


def top_brand(brands: DataFrame) -> DataFrame:
    """``ingredient, brand, n_rows``: the most frequent verified single-ingredient brand, ties by name."""
    single = brands.where(F.col("verified") & (F.size("ingredients") == 1)).select(F.col("ingredients")[0].alias("ingredient"), "brand", "n_rows")
    return first_of_each(single, ["ingredient"], [F.desc("n_rows"), F.col("brand")])


def capped(lexicon: DataFrame, key: str, most: int) -> DataFrame:
    """All priority rows, and the most frequent others up to ``most`` rows in all; ties by key. The cap is the feature."""
    priority = lexicon.where("priority")
    room = priority.agg(F.greatest(F.lit(most) - F.count(F.lit(1)), F.lit(0)).alias("room"))
    best = lexicon.where("not priority").orderBy(F.desc("n_rows"), key).limit(most)
    w = Window.orderBy(F.desc("n_rows"), key)
    kept = best.withColumn("_rn", F.row_number().over(w)).crossJoin(F.broadcast(room)).where(F.col("_rn") <= F.col("room")).drop("_rn", "room")
    return priority.unionByName(kept)
