"""Similarity joins with blocking, nearest vectors, TF-IDF postings, score fusion, glued names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..plans.session import spread
from .pairs import first_of_each


def deletions(word: Column, most: int) -> Column:
    """The word and all words that up to ``most`` (1 or 2) deletions of single letters make of it, distinct."""
    shorter = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    once = F.array_distinct(shorter(word))
    out = F.concat(F.array(word), once)
    if most == 2:
        out = F.concat(out, F.flatten(F.transform(once, shorter)))
    return F.array_distinct(out)


def within_edits(words: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """``word, name, distance`` for all pairs within ``most`` edits (Levenshtein).

    Two strings within k edits share a string that k deletions or fewer make of either, so the equi-join on those
    neighbourhoods finds every pair; the exact distance is checked behind it.
    """
    w = words.select("word", F.explode(deletions(F.col("word"), most)).alias("_k"))
    n = names.select("name", F.explode(deletions(F.col("name"), most)).alias("_k"))
    pairs = w.join(n, "_k").select("word", "name").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "name")).where(F.col("distance") <= most)


def corrected(words: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """``word, name, distance``: the single nearest name within ``most`` edits; a tie at the smallest distance abstains."""
    near = within_edits(words, names, most)
    agg = near.groupBy("word").agg(F.min("distance").alias("distance"), F.collect_list(F.struct("distance", "name")).alias("all"))
    best = F.filter("all", lambda x: x["distance"] == F.col("distance"))
    return agg.where(F.size(best) == 1).select("word", best[0]["name"].alias("name"), "distance")


def resembling(names: DataFrame, words: DataFrame, key: str, least: float) -> DataFrame:
    """``key, name``: names of a record that resemble one of its words, by an indel ratio of ``least`` or more (of 100).

    ``names``: ``key, name``; ``words``: ``key, word``. The equi-join is on the record; lengths that cannot reach the
    ratio are dropped before any distance is computed. Nulls resemble nothing.
    """
    from ..functions.similarity import indel_ratio

    met = names.select(key, "name").distinct().join(words.select(key, "word").distinct(), key)
    fits = 2 * F.least(F.length("name"), F.length("word")) * 100 >= least * (F.length("name") + F.length("word"))
    scored = spread(met.where(fits), key, "name").withColumn("score", indel_ratio("name", "word"))
    return scored.where(F.col("score") >= least).select(key, "name").distinct()


def trigrams(text: Column) -> Column:
    """Distinct character 3-grams of each word padded by a blank on either side."""
    padded = F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", "  "), F.lit(" "))
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))), lambda g: (F.length(g) == 3) & ~g.contains("  ")))


def blocked(left: DataFrame, right: DataFrame, least_ratio: float) -> DataFrame:
    """``l, r``: pairs whose lengths and shared letter pairs allow an indel ratio of ``least_ratio``.

    A ratio of t needs ``2 * min(len) >= t * (len(l) + len(r))`` and leaves room for ``(1 - t) * (len(l) + len(r))``
    edits, each of which touches two letter pairs at most; so many of the distinct letter pairs of ``l`` may be missing
    in ``r``, and no more. One shared pair is needed in any case: for t of 0.75 or more and 8 letters or more, only
    strings that share no two neighbouring letters at all are lost, which such a ratio hardly allows.
    """
    two = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    a = left.select("l", two(F.col("l")).alias("_p")).select("l", F.size("_p").alias("_n"), F.explode("_p").alias("_g"))
    b = right.select("r", F.explode(two(F.col("r"))).alias("_g"))
    length = F.length("l") + F.length("r")
    # the sides are small and what they make is large, so their partitions must not be merged by size
    met = spread(a, "_g").join(spread(b, "_g"), "_g").where(2 * F.least(F.length("l"), F.length("r")) >= least_ratio * length)
    shared = met.groupBy("l", "r", "_n").agg(F.count(F.lit(1)).alias("_s"))
    return shared.where(F.col("_s") >= F.col("_n") - 2 * F.floor((1 - least_ratio) * length + 1e-9)).select("l", "r")


#: White space as Python's ``str.split`` knows it, as a character class.
BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]"


def _letter_pairs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2))))


def _tokens(text: Column) -> Column:
    return F.array_sort(F.filter(F.split(text, f"{BLANKS}+"), lambda t: t != ""))


def _forms(side: DataFrame, name: str) -> DataFrame:
    """``<name>, form, own``: the text, and its tokens sorted, with and without repetition; ``own`` marks the text itself."""
    sorted_ = _tokens(F.col(name))
    forms = F.array_distinct(F.array(F.col(name), F.array_join(sorted_, " "), F.array_join(F.array_distinct(sorted_), " ")))
    return side.select(name).distinct().select(name, F.explode(forms).alias("form")).select(name, "form", (F.col("form") == F.col(name)).alias("own"))


def blocked_weighted(left: DataFrame, right: DataFrame, least: float = 75.0) -> DataFrame:
    """``l, r``: all pairs whose weighted ratio can reach ``least`` (75 or more), by a condition for each of its parts.

    * plain and token sort: an indel ratio of ``least`` between the texts or their sorted tokens, so a bound on edits as
      in ``blocked``; a letter taken out breaks up two letter pairs of its own text, and one put in only one;
    * token set: a token in common, else it is a token sort without repeated tokens;
    * partial, which counts 0.9 from a length ratio of 1.5 to 8: in a stretch of the longer text, ``k`` of the ``m``
      letters of the shorter one are missing, ``k <= m * (1 - least / 90)``. Each such letter and each one in its place
      breaks up letter pairs, three a letter at most, so all but ``3 * k`` distinct pairs of the shorter text are shared.

    A length ratio above 8 counts 0.6 and only reaches 60. Some letter pair is shared in every case, except by texts of
    up to eight letters, which meet by single letters.
    """
    a = _forms(left, "l").select("l", F.col("form").alias("fl"), F.col("own").alias("ol"))
    b = _forms(right, "r").select("r", F.col("form").alias("fr"), F.col("own").alias("or"))
    grams_a = a.withColumn("_pl", _letter_pairs(F.col("fl"))).select("*", F.explode("_pl").alias("_g"))
    grams_b = b.withColumn("_pr", _letter_pairs(F.col("fr"))).select("*", F.explode("_pr").alias("_g"))
    short, long = F.least(F.length("fl"), F.length("fr")), F.greatest(F.length("fl"), F.length("fr"))
    t = least / 100
    alike = 2 * short >= t * (short + long) - 1e-9
    part = F.col("ol") & F.col("or") & (2 * long >= 3 * short) & (long <= 8 * short)
    edits, longer = F.floor((1 - t) * (short + long) + 1e-9), F.length("fl") - F.length("fr")
    enough = F.greatest(F.size("_pl") - (3 * edits + longer) / 2, F.size("_pr") - (3 * edits - longer) / 2)
    fewer = F.when(F.length("fl") <= F.length("fr"), F.size("_pl")).otherwise(F.size("_pr"))
    inside = (fewer - 3 * F.floor(short * (1 - least / 90) + 1e-9)).cast("double")
    needed = F.least(F.when(alike, enough), F.when(part, inside))
    # counted where a pair meets, at its first shared letter pair only: what meets is many times what is kept, and not shuffled
    kept = F.exists(F.array(F.array_intersect("_pl", "_pr")), lambda both: (both[0] == F.col("_g")) & (F.size(both) >= needed))
    by_letters = spread(grams_a, "_g").join(spread(grams_b, "_g"), "_g").where((alike | part) & kept).select("l", "r")
    token = lambda side, name: side.select(name, F.explode(F.array_distinct(_tokens(F.col(name)))).alias("_g")).distinct()
    by_token = spread(token(left, "l"), "_g").join(spread(token(right, "r"), "_g"), "_g").where((F.length("l") <= 8 * F.length("r")) & (F.length("r") <= 8 * F.length("l"))).select("l", "r")
    letters = lambda form: F.explode(F.array_distinct(F.split(form, ""))).alias("_g")
    tiny_a = a.where(F.length("fl") <= 8).select("l", letters("fl"))
    tiny_b = b.where(F.length("fr") <= 8).select("r", letters("fr"))
    tiny = tiny_a.join(tiny_b, "_g").where("_g != ''").select("l", "r")
    return by_letters.unionByName(by_token).unionByName(tiny).distinct()


def blocked_alike(left: DataFrame, right: DataFrame, least_ratio: float) -> DataFrame:
    """``l, r``: all pairs whose gestalt or indel ratio can reach ``least_ratio`` (above 0.8); both sides distinct.

    Such a pair leaves room for ``(1 - t) * (len(l) + len(r))`` edits. A letter taken out breaks up two letter pairs of
    its own text, and one put in only one; so few edits always leave a letter pair in common. The letter pairs of both
    texts are held against each other as 64-bit maps where they meet, so that only what is kept is shuffled.
    """
    bits = F.expr("aggregate(_p, 0L, (m, g) -> m | shiftleft(1L, cast(pmod(xxhash64(g), 64) as int)))")
    side = lambda rows, name, m: rows.select(name, _letter_pairs(F.col(name)).alias("_p")).select(name, bits.alias(m), F.explode("_p").alias("_g"))
    length, longer = F.length("l") + F.length("r"), F.length("l") - F.length("r")
    edits = F.floor((1 - least_ratio) * length + 1e-9)
    alone = lambda x, y: 2 * F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    near = (2 * F.least(F.length("l"), F.length("r")) >= least_ratio * length - 1e-9) & (alone("_ml", "_mr") <= 3 * edits + longer) & (alone("_mr", "_ml") <= 3 * edits - longer)
    return spread(side(left, "l", "_ml"), "_g").join(spread(side(right, "r", "_mr"), "_g"), "_g").where(near).select("l", "r").distinct()


def cosines(queries: DataFrame, corpus: DataFrame, block: int = 1024) -> DataFrame:
    """``q, <corpus columns>, score`` for every query and every vector of the corpus, which is a stated query set against all rows.

    ``queries``: ``q, vec``; ``corpus``: ``vec`` and any columns. Queries are split by hash into blocks of about
    ``block``; only a block is ever broadcast, so memory does not grow with the query set. Null vectors are left out, a
    zero vector scores null.
    """
    kept = [c for c in corpus.columns if c != "vec"]
    c = corpus.where("vec is not null").select(*kept, V.doubles("vec").alias("_v")).select("*", V.norm(F.col("_v")).alias("_nv"))
    q = queries.where("vec is not null").select("q", V.doubles("vec").alias("_w")).select("*", V.norm(F.col("_w")).alias("_nw"))
    blocks = max(1, -(-queries.count() // block))
    out = None
    for k in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k)
        scored = c.crossJoin(F.broadcast(part)).select("q", *kept, F.try_divide(V.dot(F.col("_v"), F.col("_w")), F.col("_nv") * F.col("_nw")).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def top_cosine(queries: DataFrame, corpus: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """``q, id, score, rank``: the ``k`` nearest vectors of each query; ties by id. Every partition keeps its own best
    ``k`` per query before anything is shuffled."""
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id")
    return cosines(queries, corpus.select("id", "vec"), block).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tfidf(docs: DataFrame, least_df: int = 2) -> DataFrame:
    """``doc, gram, w``: 3-gram weights ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``, each document of length one.

    Grams in fewer than ``least_df`` documents are left out.
    """
    grams = docs.select("doc", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substr(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), i, F.lit(3))), lambda g: F.length(g) == 3)).alias("gram"))
    tf = grams.groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df)
    n = docs.agg(F.count_distinct("doc").alias("n"))
    raw = tf.join(df, "gram").crossJoin(F.broadcast(n)).select("doc", "gram", ((1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    length = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("len"))
    return raw.join(length, "doc").select("doc", "gram", (F.col("raw") / F.col("len")).alias("w"))


def fuse(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``q, concept, fused``: weighted sum of the signals, each brought to 0..1 within a query.

    A missing signal counts 0 and takes part in the range; a range below 1e-9 makes the signal 0 for all.
    """
    w = Window.partitionBy("q")
    total = F.lit(0.0)
    for name, weight in weights.items():
        value = F.coalesce(name, F.lit(0.0))
        low, high = F.min(value).over(w), F.max(value).over(w)
        total = total + weight * F.when(high - low < 1e-9, 0.0).otherwise((value - low) / (high - low))
    return scores.select("q", "concept", total.alias("fused"))


def margins(scores: DataFrame, q: str, concept: str, score: str) -> DataFrame:
    """``q, concept, score, lead``: the best concept and its lead over the next; ties by concept."""
    w = Window.partitionBy(q).orderBy(F.desc(F.round(score, 9)), concept)
    ranked = scores.select(q, concept, score, F.row_number().over(w).alias("_rn")).where("_rn <= 2")
    return ranked.groupBy(q).agg(F.max_by(concept, -F.col("_rn")).alias("concept"), F.max(score).alias("score"), (F.max(score) - F.when(F.count(F.lit(1)) > 1, F.min(score)).otherwise(0.0)).alias("lead"))


def segment(words: DataFrame, names: DataFrame, shortest: int = 8) -> DataFrame:
    """``word, pieces``: words glued of two or three known names, first split first; known words are never split."""
    long = words.where((F.length("word") >= shortest) & ~F.col("word").contains(" ")).join(names.select(F.col("name").alias("word")), "word", "left_anti")
    cut = long.select("word", F.explode(F.sequence(F.lit(2), F.length("word") - 1)).alias("i")).select("word", "i", F.substr("word", F.lit(1), F.col("i")).alias("a"), F.substr("word", F.col("i") + 1).alias("rest"))
    known = cut.join(names.select(F.col("name").alias("a")), "a", "left_semi")
    two = known.join(names.select(F.col("name").alias("rest")), "rest", "left_semi").select("word", "i", F.lit(0).alias("j"), F.array("a", "rest").alias("pieces"))
    again = known.where(F.length("rest") >= 4).select("word", "i", "a", "rest", F.explode(F.sequence(F.lit(2), F.length("rest") - 2)).alias("j"))
    parts = again.select("word", "i", "j", "a", F.substr("rest", F.lit(1), F.col("j")).alias("b"), F.substr("rest", F.col("j") + 1).alias("c"))
    three = parts.join(names.select(F.col("name").alias("b")), "b", "left_semi").join(names.select(F.col("name").alias("c")), "c", "left_semi").select("word", "i", "j", F.array("a", "b", "c").alias("pieces"))
    return first_of_each(two.unionByName(three), ["word"], [F.col("i"), F.col("j")]).select("word", "pieces")
