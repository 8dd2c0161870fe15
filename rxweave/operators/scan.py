"""Tokens, n-gram candidates, dictionary scans, vocabularies, combination splits, brand texts and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")


def grams(rows: DataFrame, key: str, words: str, longest: int) -> DataFrame:
    """``key, n, at, words``: all runs of 1 to ``longest`` words."""
    ns = F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")
    sized = rows.select(key, F.col(words).alias("_ws"), ns).where(F.size("_ws") >= F.col("n"))
    return sized.select(key, "_ws", "n", F.explode(F.sequence(F.lit(0), F.size("_ws") - F.col("n"))).alias("at")).select(key, "n", "at", F.slice("_ws", F.col("at") + 1, F.col("n")).alias("words"))


def candidates(rows: DataFrame, key: str, words: str, most: int) -> DataFrame:
    """1- and 2-grams without connectors, of three letters or more and not all stopwords; at most ``most`` a record."""
    g = grams(rows, key, words, 2)
    joined = F.array_join("words", " ")
    kept = g.where(~F.exists("words", lambda w: w.isin(*T.CONNECTORS)) & (F.length(joined) >= 3) & F.exists("words", lambda w: ~w.isin(*T.STOPWORDS)))
    w = Window.partitionBy(key).orderBy("n", "at")
    return kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).select(key, "n", "at", joined.alias("candidate"))


def dictionary(rows: DataFrame, key: str, words: str, keys: DataFrame, longest: int | None = None) -> DataFrame:
    """``key column, at, n, key``: entries of a dictionary in each record, leftmost longest first, without overlaps.

    The n-grams, up to the longest entry's number of words, are joined to the dictionary, and a fold over each record's
    few hits drops what overlaps. Entries are words joined by single blanks.
    """
    if longest is None:  # when the plan is built: one number
        longest = keys.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1
    g = grams(rows, key, words, longest).select(key, "at", "n", F.array_join("words", " ").alias("key"))
    hits = g.join(keys.select("key").distinct(), "key").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "key"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n:int,key:string>>").alias("kept"))
    fold = F.aggregate(
        "hits",
        start,
        lambda acc, h: F.when(h["at"] >= acc["end"], F.struct((h["at"] - h["m"]).alias("end"), F.concat(acc["kept"], F.array(F.struct(h["at"].alias("at"), (-h["m"]).alias("n"), h["key"].alias("key")))).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return hits.select(key, F.explode(fold).alias("x")).select(key, "x.at", "x.n", "x.key")


def vocabulary(words: DataFrame, word: str, size: int) -> DataFrame:
    """``w, n, id``: the ``size - 2`` most frequent words, ties by word; ids 0 and 1 are kept for padding and unknown."""
    counts = words.groupBy(F.col(word).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "w").limit(size - 2)
    return top.select("w", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "w")) + 1).alias("id"))


def encode(words: DataFrame, key: str, word: str, at: str, vocab: DataFrame) -> DataFrame:
    """``key, ids``: word ids in order, 1 for unknown words. The vocabulary has a fixed size, so it is broadcast."""
    joined = words.join(F.broadcast(vocab.select(F.col("w").alias(word), "id")), word, "left")
    sorted_ids = F.array_sort(F.collect_list(F.struct(at, F.coalesce("id", F.lit(1)).alias("id"))))
    return joined.groupBy(key).agg(F.transform(sorted_ids, lambda x: x["id"]).alias("ids"))


def split_combos(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``mention, fragments``: parts by delimiters, else by a known suffix if the stem is exactly known."""
    low = F.lower(F.trim("mention"))
    pattern = r"^(.+)[-_](am|h|m|d|plus|ls|ln)$"
    parts = rows.select("mention", T.combo_parts(F.col("mention")).alias("parts"), F.regexp_extract(low, pattern, 1).alias("name"), F.regexp_extract(low, pattern, 2).alias("suffix"))
    joined = parts.join(known.select("name", F.lit(True).alias("is_known")), "name", "left")
    agent = F.create_map(*(F.lit(x) for kv in T.SUFFIX_AGENTS.items() for x in kv))[F.col("suffix")]
    exact = F.col("is_known").isNotNull()
    fragments = (
        F.when(F.size("parts") > 1, F.col("parts"))
        .when(exact & F.col("suffix").isin(*T.SUFFIX_DROPPED), F.array("name"))
        .when(exact & agent.isNotNull(), F.array(F.col("name"), agent))
        .otherwise(F.array(low))
    )
    return joined.select("mention", fragments.alias("fragments"))


def literally(text: Column) -> Column:
    """A pattern that stands for the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def brand_texts(rx: DataFrame, reference: DataFrame) -> DataFrame:
    """``prescription_id, substituted, text``: every name of the list in a prescription replaced by its first brand.

    Longer names go first; a name counts only where no letter follows it, so glued doses stay.
    """
    brands = reference.where(F.size("brand_names") > 0).select(F.lower("drug_name").alias("g"), F.col("brand_names")[0].alias("brand"))
    names = rx.select("prescription_id", F.explode("drugs").alias("drug")).where("drug is not null").select("prescription_id", T.name_key(F.col("drug")).alias("g")).distinct()
    subs = names.join(brands, "g").groupBy("prescription_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("g")).alias("k"), "g", "brand"))).alias("subs"))
    put = F.reduce(F.coalesce("subs", F.array().cast("array<struct<k:int,g:string,brand:string>>")), F.col("prescription_text"), lambda t, s: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b"), literally(s["g"]), F.lit("(?![A-Za-z])")), F.regexp_replace(s["brand"], r"([\\$])", r"\\$1")))
    joined = rx.select("prescription_id", "prescription_text").join(subs, "prescription_id", "left")
    return joined.select("prescription_id", F.coalesce(F.size("subs"), F.lit(0)).cast("bigint").alias("substituted"), put.alias("text"))


# What scanners read for some letters, for two whole words, and the strength of a drug.
CONFUSIONS = {"e": "c", "rn": "m", "0": "O"}
CONFUSED_WORDS = {"daily": "daiIy", "vitamin": "v1tam1n"}
STRENGTH = r"\s*\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|ug|g|ml|iu|units?|%)\b"
#: White space of any kind, as a character class that Java and RE2 read alike.
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def noise_letters(key: Column, text: Column) -> Column:
    """Up to two confusions of ``CONFUSIONS``, at places chosen by the hash of key and place."""
    at = lambda i: F.when(F.substr(text, i, F.lit(2)) == "rn", F.lit("rn")).otherwise(F.substr(text, i, F.lit(1)))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: at(i).isin(*CONFUSIONS))
    hashed = F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"))))
    last_first = F.sort_array(F.transform(F.slice(hashed, 1, 2), lambda p: p["i"]), asc=False)

    def confused(t: Column, i: Column) -> Column:
        read = F.create_map(*(F.lit(x) for kv in CONFUSIONS.items() for x in kv))
        return F.concat(F.substr(t, F.lit(1), i - 1), read[at(i)], F.substr(t, i + F.length(at(i))))

    return F.reduce(last_first, text, confused)


def noise_glued(text: Column, names: Column) -> Column:
    """Lower case, doses glued to the given names and then to any word before, and two scanner confusions."""
    glue = lambda t, s: F.regexp_replace(t, F.concat(literally(s), F.lit(rf"{BLANK}+(?=\d)")), F.regexp_replace(s, r"([\\$])", r"\\$1"))
    own = F.reduce(_longest_first(names), F.lower(text), glue)
    out = F.regexp_replace(own, rf"([a-z]){BLANK}+(\d+{BLANK}*(?:mg|mcg|g|ml|iu)\b)", "$1$2")
    for word, read in CONFUSED_WORDS.items():
        out = F.replace(out, F.lit(word), F.lit(read))
    return out


def _longest_first(names: Column) -> Column:
    """Distinct lower-cased names that are not empty, longest first, then by name."""
    kept = F.array_distinct(F.transform(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), F.lower))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def _cut_line(line: Column, names: Column) -> Column:
    """A line up to its last name and three words more, a line without a name up to its third word; cuts end with dots."""
    ends = F.transform(names, lambda s: F.when(F.instr(F.lower(line), s) > 0, F.instr(F.lower(line), s) - 1 + F.length(s)).otherwise(0))
    end = F.coalesce(F.array_max(ends), F.lit(0))
    tail = F.filter(F.split(F.substr(line, end + 1), f"{BLANK}+"), lambda w: w != "")
    head = F.substr(line, F.lit(1), end)
    return F.when(F.size(tail) > 3, F.concat(head, F.array_join(F.slice(tail, 1, 3), " "), F.lit(" ..."))).otherwise(line)


def noise_dropped(key: Column, text: Column, names: Column, prefixes: tuple[str, ...]) -> Column:
    """An opening chosen by the key's hash before the text without its doses, each line cut behind its last name; if a
    name were lost that way, no line is cut."""
    number = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % len(prefixes)
    opening = F.element_at(F.array(*map(F.lit, prefixes)), (number + 1).cast("int"))
    whole = F.concat(opening, F.regexp_replace(text, f"(?i){STRENGTH}", ""))
    wanted = _longest_first(names)
    cut = F.array_join(F.transform(F.split(whole, "\n"), lambda line: _cut_line(line, wanted)), "\n")
    return F.when(F.exists(wanted, lambda s: ~F.contains(F.lower(cut), s)), whole).otherwise(cut)
