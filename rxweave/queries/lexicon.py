"""Lexicon building over drug names, brands, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon as L
from ..operators import matching as X
from ..operators import scan
from ..sources.tables import table
from .registry import RX, key_sql, query, rx, strip_sql
from .text import STOPS, TOKENS, clean_sql

REF = "rf AS (SELECT drug_id, lower(drug_name) AS name, brand_names, drug_class FROM drug_reference), al AS (SELECT lower(alias) AS alias, name AS concept FROM (SELECT name, unnest(brand_names) AS alias FROM rf) WHERE alias IS NOT NULL)"


def generics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "drug_reference").select(F.lower("drug_name").alias("name"), "drug_id", "brand_names", "drug_class")


def aliases(spark: SparkSession, d: str) -> DataFrame:
    return generics(spark, d).select(F.col("name").alias("concept"), F.explode("brand_names").alias("alias")).where("alias is not null").select(F.lower("alias").alias("alias"), "concept")


US = f"us AS (SELECT DISTINCT {key_sql('drug')} AS alias FROM (SELECT unnest(drugs) AS drug FROM keyword_smoke10) WHERE drug IS NOT NULL)"
USED = f"{REF}, {US}"


def used_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names in use, stripped and lower-cased."""
    return table(spark, d, "keyword_smoke10").select(F.explode("drugs").alias("drug")).where("drug is not null").select(T.name_key(F.col("drug")).alias("alias")).distinct()


@query(f"WITH {USED} SELECT alias, concept, 'brand' AS source FROM al WHERE alias <> concept UNION SELECT us.alias, 'class:' || drug_class, 'class' FROM us JOIN rf ON rf.name = us.alias UNION SELECT lower(drug_class), name, 'synonym' FROM rf")
def alias_union(spark: SparkSession, d: str) -> DataFrame:
    """Aliases from three sources, each pair once per source, without names of themselves."""
    g = generics(spark, d)
    brands = aliases(spark, d).where("alias != concept").select("alias", "concept", F.lit("brand").alias("source"))
    classes = used_names(spark, d).join(g.select(F.col("name").alias("alias"), F.concat(F.lit("class:"), "drug_class").alias("concept")), "alias").select("alias", "concept", F.lit("class").alias("source"))
    synonyms = g.select(F.lower("drug_class").alias("alias"), F.col("name").alias("concept"), F.lit("synonym").alias("source"))
    return brands.unionByName(classes).unionByName(synonyms).distinct()


JUNK = "(len({0}) <= 1 OR len({0}) > 60 OR regexp_matches({0}, '\\d{{5,}}-\\d{{2}}-\\d') OR regexp_matches({0}, '^[^a-z]+$') OR regexp_matches({0}, '^ns(-|%| )?') OR regexp_matches({0}, '[%\\[\\(/:+]') OR regexp_matches({0}, 'stayhappi'))"


@query(f"WITH {USED}, pool AS (SELECT alias, concept FROM al UNION ALL SELECT alias, 'entered' FROM us) SELECT {strip_sql('alias')} AS alias, min(concept) AS concept FROM pool WHERE NOT {JUNK.format(strip_sql('alias'))} AND {strip_sql('alias')} NOT IN (SELECT name FROM rf) GROUP BY 1")
def alias_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = aliases(spark, d).unionByName(used_names(spark, d).select("alias", F.lit("entered").alias("concept")))
    return L.alias_pool(pool, generics(spark, d))


@query(f"WITH {USED} SELECT alias, {JUNK.format('trim(alias)')} AS junk, NOT {JUNK.format('trim(alias)')} AND len(trim(alias)) > 4 AND len(trim(alias)) <= 40 AS good_surface FROM us")
def junk_filter(spark: SparkSession, d: str) -> DataFrame:
    return used_names(spark, d).select("alias", T.junk_alias(F.col("alias")).alias("junk"), T.good_surface(F.col("alias"), F.lit(False)).alias("good_surface"))


@query(f"WITH {USED} SELECT alias FROM us WHERE NOT {JUNK.format('trim(alias)')} EXCEPT SELECT name FROM rf")
def except_junk(spark: SparkSession, d: str) -> DataFrame:
    names = used_names(spark, d)
    return names.where(~T.junk_alias(F.col("alias"))).join(generics(spark, d).select(F.col("name").alias("alias")), "alias", "left_anti")


SYN = f"{REF}, base AS (SELECT name AS alias, [name] AS concepts FROM rf UNION ALL SELECT DISTINCT alias, [alias || ' (base)'] FROM al WHERE len(alias) % 2 = 0 UNION ALL SELECT DISTINCT drug_class || ' old', [drug_class] FROM rf), ov AS (SELECT alias, list_sort(list(concept)) AS concepts FROM al GROUP BY alias)"
UP = f"{SYN}, up AS (SELECT coalesce(o.alias, b.alias) AS alias, coalesce(o.concepts, b.concepts) AS concepts, CASE WHEN o.alias IS NOT NULL THEN 'over' ELSE 'base' END AS source FROM base b FULL JOIN ov o ON b.alias = o.alias)"


def merged_synonyms(spark: SparkSession, d: str) -> DataFrame:
    al = aliases(spark, d)
    base = generics(spark, d).select(F.col("name").alias("alias"), F.array("name").alias("concepts")).unionByName(al.where(F.length("alias") % 2 == 0).select("alias", F.array(F.concat("alias", F.lit(" (base)"))).alias("concepts")).distinct())
    old = generics(spark, d).select(F.concat("drug_class", F.lit(" old")).alias("alias"), F.array("drug_class").alias("concepts")).distinct()
    base = base.unionByName(old)
    over = al.groupBy("alias").agg(F.array_sort(F.collect_list("concept")).alias("concepts"))
    return L.upsert(base, over)


@query(f"WITH {UP} SELECT alias, concepts, source FROM up")
def lexicon_upsert(spark: SparkSession, d: str) -> DataFrame:
    return merged_synonyms(spark, d)


@query(f"WITH {UP}, {US} SELECT alias, concepts FROM up WHERE source = 'base' AND alias NOT IN (SELECT alias FROM ov) AND alias NOT IN (SELECT alias FROM us)")
def stale_delete(spark: SparkSession, d: str) -> DataFrame:
    """Base keys that neither the current lexicon nor any entry uses: what a rebuild deletes."""
    merged = merged_synonyms(spark, d).where("source = 'base'").select("alias", "concepts")
    current = aliases(spark, d).select("alias").unionByName(used_names(spark, d))
    return merged.join(current, "alias", "left_anti")


MENTION_NAMES = f"{UP}, us AS (SELECT DISTINCT drug AS mention FROM (SELECT unnest(drugs) AS drug FROM keyword_smoke10) WHERE drug IS NOT NULL AND regexp_matches(drug, '^[\\x20-\\x7E]*$'))"


@query(
    f"""WITH {MENTION_NAMES}, k AS (SELECT mention, {key_sql("mention")} AS raw, {clean_sql("mention")} AS cleaned FROM us), j AS (SELECT mention, raw, a.concepts AS c1, b.concepts AS c2 FROM k LEFT JOIN up a ON a.alias = raw LEFT JOIN up b ON b.alias = cleaned)
SELECT mention, unnest(CASE WHEN len(raw) <= 2 AND raw IN ({STOPS}) THEN [raw] ELSE coalesce(c1, c2, [raw]) END) AS name, CASE WHEN len(raw) <= 2 AND raw IN ({STOPS}) THEN 'stopword' WHEN c1 IS NOT NULL THEN 'raw' WHEN c2 IS NOT NULL THEN 'cleaned' ELSE 'itself' END AS step FROM j"""
)
def synonym_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Entries in plain ASCII, on which the engines' word boundaries agree, resolved by alias, cleaned alias or left alone.

    ``synonym_resolve_whole`` takes all entries."""
    entered = table(spark, d, "keyword_smoke10").select(F.explode("drugs").alias("mention")).where(F.col("mention").rlike(r"^[\x20-\x7E]*$")).distinct()
    return L.resolve(entered, merged_synonyms(spark, d).select("alias", "concepts"))


@query()
def synonym_resolve_whole(spark: SparkSession, d: str) -> DataFrame:
    """All entries, of any script and with any blanks, resolved by alias, cleaned alias or left alone."""
    entered = table(spark, d, "keyword_smoke10").select(F.explode("drugs").alias("mention")).where("mention is not null").distinct()
    return L.resolve(entered, merged_synonyms(spark, d).select("alias", "concepts"), T.clean_any_mention)


@query(f"WITH {TOKENS}, {REF}, sf AS (SELECT name, name AS surface FROM rf UNION SELECT concept, alias FROM al), g AS (SELECT DISTINCT prescription_id, array_to_string(words, ' ') AS w FROM grams), h AS (SELECT DISTINCT prescription_id, name FROM g JOIN sf ON sf.surface = g.w), e AS (SELECT DISTINCT prescription_id, {key_sql('drug')} AS name FROM (SELECT prescription_id, unnest(drugs) AS drug FROM rx) WHERE drug IS NOT NULL) SELECT e.prescription_id, e.name FROM e JOIN h USING (prescription_id, name)")
def grounding_semi(spark: SparkSession, d: str) -> DataFrame:
    """Names of a prescription that its text has, as such or by a brand, on word boundaries."""
    g = generics(spark, d)
    surfaces = g.select("name", F.col("name").alias("surface")).unionByName(aliases(spark, d).select(F.col("concept").alias("name"), F.col("alias").alias("surface"))).distinct()
    rows = rx(spark, d)
    grams = scan.grams(rows.select("prescription_id", scan.tokens(F.col("prescription_text")).alias("ws")), "prescription_id", "ws", 2).select("prescription_id", F.array_join("words", " ").alias("surface")).distinct()
    heard = grams.join(surfaces, "surface").select("prescription_id", "name").distinct()
    own = rows.select("prescription_id", F.explode("drugs").alias("drug")).where("drug is not null").select("prescription_id", T.name_key(F.col("drug")).alias("name")).distinct()
    return own.join(heard, ["prescription_id", "name"], "left_semi")


@query()
def grounding_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Names of a prescription that resemble a word of its text (indel ratio of 85 or more)."""
    rows = rx(spark, d)
    names = rows.select("prescription_id", F.explode("drugs").alias("drug")).where("drug is not null").select("prescription_id", T.name_key(F.col("drug")).alias("name"))
    words = rows.select("prescription_id", F.explode(scan.tokens(T.glued_presplit(F.col("prescription_text")))).alias("word"))
    return X.resembling(names.where("name != ''"), words, "prescription_id", 85.0)


@query(f"WITH {USED} SELECT alias FROM us WHERE alias IN (SELECT name FROM rf) OR alias IN (SELECT alias FROM al)")
def known_name_semi(spark: SparkSession, d: str) -> DataFrame:
    known = generics(spark, d).select(F.col("name").alias("alias")).unionByName(aliases(spark, d).select("alias"))
    return used_names(spark, d).join(known, "alias", "left_semi")


STAR = """st AS (SELECT p_name AS brand, p_brand AS product, n_name AS supplier_nation, s_name AS supplier, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


@query(f"WITH {STAR} SELECT brand, product, list_sort(list(DISTINCT supplier_nation)) AS nations, count(DISTINCT supplier) AS suppliers, sum(n)::BIGINT AS n_rows FROM st GROUP BY brand, product")
def star_brand_join(spark: SparkSession, d: str) -> DataFrame:
    """The fact table with its dimensions; counts come before the joins' wide rows are grouped."""
    facts = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("brand"), F.col("p_brand").alias("product"))
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = facts.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("brand", "product").agg(F.array_sort(F.collect_set("n_name")).alias("nations"), F.count_distinct("s_name").alias("suppliers"), F.sum("n").alias("n_rows"))


ING = "ig AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN upper(p_name) || ' Sodium' WHEN 1 THEN split_part(p_name, ' ', 2) || ' (' || split_part(p_name, ' ', 1) || ')' WHEN 2 THEN replace(p_name, ' ', '-') ELSE p_name || ' 500 mg' END AS raw FROM part), kn AS (SELECT DISTINCT lower(p_name) AS name FROM part)"


@query(f"WITH {ING} SELECT raw, CASE WHEN raw LIKE '% 500 mg' THEN NULL WHEN raw LIKE '%(%' THEN (SELECT name FROM kn WHERE name = split_part(split_part(raw, '(', 2), ')', 1) || ' ' || split_part(raw, ' (', 1)) ELSE (SELECT name FROM kn WHERE name = replace(regexp_replace(lower(raw), ' sodium$', ''), '-', ' ')) END AS ingredient FROM ig")
def ingredient_normalize(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 4
    words = F.split("p_name", " ")
    raw = F.when(size == 0, F.concat(F.upper("p_name"), F.lit(" Sodium"))).when(size == 1, F.concat(words[1], F.lit(" ("), words[0], F.lit(")"))).when(size == 2, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.concat("p_name", F.lit(" 500 mg")))
    part = table(spark, d, "part")
    known = part.select(F.lower("p_name").alias("name")).distinct().withColumn("canonical", F.col("name"))
    return L.normalize_ingredients(part.select(raw.alias("raw")).distinct(), known)


VOTES = """fv AS (SELECT p_name || '|' || p_brand AS key, l_returnflag AS source, CASE WHEN l_partkey % 3 = 0 THEN [p_type] ELSE list_sort(list_distinct([p_type, p_brand])) END AS ings FROM lineitem JOIN part ON l_partkey = p_partkey),
ct AS (SELECT key, ings, count(*) AS votes, sum(CASE WHEN source = 'R' THEN 3 ELSE 1 END)::BIGINT AS score FROM fv GROUP BY ALL), rt AS (SELECT *, (sum(votes) OVER (PARTITION BY key))::BIGINT AS rows, max(score) OVER (PARTITION BY key) AS top FROM ct),
wn AS (SELECT key, ings, votes, score, rows, rows >= 2 AND votes >= greatest(2, rows // 2) AS verified FROM rt WHERE score * 2 >= top QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(ings) DESC, score DESC, ings) = 1)"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ings = F.when(F.col("l_partkey") % 3 == 0, F.array("p_type")).otherwise(F.array_sort(F.array_distinct(F.array("p_type", "p_brand"))))
    return L.vote(rows.select(F.concat("p_name", F.lit("|"), "p_brand").alias("key"), F.col("l_returnflag").alias("source"), ings.alias("ings")), "key", "source", "ings", "R")


@query(f"WITH {VOTES} SELECT key, ings, votes, score, rows, verified FROM wn")
def brand_vote(spark: SparkSession, d: str) -> DataFrame:
    return votes(spark, d)


@query(f"WITH {VOTES}, ex AS (SELECT p_name || '|' || p_brand AS key, list_sort(list_distinct(list(p_type))) AS expected FROM part GROUP BY 1) SELECT key, CASE WHEN len(list_filter(ings, lambda x: NOT list_contains(expected, x))) > 0 THEN 'mismatch' WHEN len(ings) < len(expected) THEN 'incomplete' ELSE 'equal' END AS verdict FROM wn JOIN ex USING (key)")
def qa_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Winning lists against expected ones: equal, a proper part, or something else."""
    expected = table(spark, d, "part").groupBy(F.concat("p_name", F.lit("|"), "p_brand").alias("key")).agg(F.array_sort(F.collect_set("p_type")).alias("expected"))
    extra = F.size(F.array_except("ings", "expected"))
    verdict = F.when(extra > 0, "mismatch").when(F.size("ings") < F.size("expected"), "incomplete").otherwise("equal")
    return votes(spark, d).join(expected, "key").select("key", verdict.alias("verdict"))


LEX = "lx AS (SELECT p_name || '|' || p_brand AS key, count(*) AS n_rows, bool_or(p_size = 1) AS priority FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


@query(f"WITH {LEX}, pr AS (SELECT * FROM lx WHERE priority) SELECT key, n_rows, priority FROM pr UNION ALL SELECT key, n_rows, priority FROM (SELECT *, row_number() OVER (ORDER BY n_rows DESC, key) AS rn FROM lx WHERE NOT priority) WHERE rn <= greatest(200 - (SELECT count(*) FROM pr), 0)")
def lexicon_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lex = rows.groupBy(F.concat("p_name", F.lit("|"), "p_brand").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(F.col("p_size") == 1).alias("priority"))
    return L.capped(lex, "key", 200)


@query(f"WITH {LEX}, lx2 AS (SELECT key, n_rows FROM lx) SELECT key, n_rows, false AS seed FROM lx2 UNION ALL SELECT 'seed|' || lower(drug_class), 0, true FROM (SELECT DISTINCT drug_class FROM drug_reference) s WHERE 'seed|' || lower(drug_class) NOT IN (SELECT key FROM lx2)")
def seed_guarantee(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon and every seed key that it lacks."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lex = rows.groupBy(F.concat("p_name", F.lit("|"), "p_brand").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    seeds = table(spark, d, "drug_reference").select(F.concat(F.lit("seed|"), F.lower("drug_class")).alias("key")).distinct()
    missing = seeds.join(lex, "key", "left_anti").select("key", F.lit(0).cast("bigint").alias("n_rows"), F.lit(True).alias("seed"))
    return lex.withColumn("seed", F.lit(False)).unionByName(missing)


TOP = f"{VOTES}, tb AS (SELECT ings[1] AS ingredient, key AS brand, rows AS n_rows FROM wn WHERE verified AND len(ings) = 1)"


def brand_rows(spark: SparkSession, d: str) -> DataFrame:
    return votes(spark, d).select(F.col("ings").alias("ingredients"), F.col("key").alias("brand"), F.col("rows").alias("n_rows"), "verified")


@query(f"WITH {TOP} SELECT ingredient, brand, n_rows FROM tb QUALIFY row_number() OVER (PARTITION BY ingredient ORDER BY n_rows DESC, brand) = 1")
def top_brand_per_ingredient(spark: SparkSession, d: str) -> DataFrame:
    return L.top_brand(brand_rows(spark, d))


@query(f"WITH {VOTES} SELECT key, ings[1] AS ingredient FROM wn WHERE verified AND len(ings) = 1")
def verified_single_ingredient(spark: SparkSession, d: str) -> DataFrame:
    return votes(spark, d).where(F.col("verified") & (F.size("ings") == 1)).select("key", F.col("ings")[0].alias("ingredient"))


STATUS = f"{USED}, sl AS (SELECT {key_sql('drug')} AS g, count(*) AS slots FROM (SELECT unnest(drugs) AS drug FROM keyword_smoke10) WHERE drug IS NOT NULL GROUP BY 1), cs AS (SELECT g, slots, CASE WHEN EXISTS (SELECT 1 FROM al WHERE concept = g) THEN 'substituted' WHEN EXISTS (SELECT 1 FROM al WHERE alias = g) THEN 'already_brand' ELSE 'no_verified_brand' END AS status FROM sl)"


def status(spark: SparkSession, d: str) -> DataFrame:
    al = aliases(spark, d)
    slots = table(spark, d, "keyword_smoke10").select(F.explode("drugs").alias("drug")).where("drug is not null").groupBy(T.name_key(F.col("drug")).alias("g")).agg(F.count(F.lit(1)).alias("slots"))
    branded = al.select(F.col("concept").alias("g"), F.lit(True).alias("has")).distinct()
    brands = al.select(F.col("alias").alias("g"), F.lit(True).alias("is")).distinct()
    kind = F.when(F.col("has").isNotNull(), "substituted").when(F.col("is").isNotNull(), "already_brand").otherwise("no_verified_brand")
    return slots.join(branded, "g", "left").join(brands, "g", "left").select("g", "slots", kind.alias("status"))


@query(f"WITH {STATUS} SELECT status, count(*) AS unique_names, sum(slots)::BIGINT AS slots FROM cs GROUP BY status")
def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    return status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("unique_names"), F.sum("slots").alias("slots"))


@query(
    f"""WITH {RX}, {STATUS}, it AS (SELECT prescription_id, pos, drug, {key_sql("drug")} AS g FROM (SELECT prescription_id, unnest(drugs) AS drug, unnest(range(len(drugs))) AS pos FROM rx) WHERE drug IS NOT NULL),
b AS (SELECT concept AS g, min(alias) AS brand FROM al GROUP BY 1) SELECT prescription_id, list(drug ORDER BY pos) AS originals, list(coalesce(brand, drug) ORDER BY pos) AS surfaces, list(status ORDER BY pos) AS statuses FROM it JOIN cs USING (g) LEFT JOIN b USING (g) GROUP BY prescription_id"""
)
def linking_projection(spark: SparkSession, d: str) -> DataFrame:
    """Aligned arrays of the original, the brand put in its place and the status of every slot."""
    items = rx(spark, d).select("prescription_id", F.posexplode("drugs").alias("pos", "drug")).where("drug is not null").withColumn("g", T.name_key(F.col("drug")))
    brand = aliases(spark, d).groupBy(F.col("concept").alias("g")).agg(F.min("alias").alias("brand"))
    joined = items.join(status(spark, d).select("g", "status"), "g").join(brand, "g", "left")
    slots = F.array_sort(F.collect_list(F.struct("pos", "drug", F.coalesce("brand", "drug").alias("surface"), "status")))
    return joined.groupBy("prescription_id").agg(slots.alias("s")).select("prescription_id", F.col("s.drug").alias("originals"), F.col("s.surface").alias("surfaces"), F.col("s.status").alias("statuses"))


@query("WITH r AS (SELECT * FROM keyword_smoke10 QUALIFY row_number() OVER (PARTITION BY prescription_id ORDER BY loaded_at DESC) = 1) SELECT prescription_id, len(interactions)::INT AS n FROM r WHERE has_interaction AND len(interactions) > 0 ORDER BY prescription_id LIMIT 50")
def subset_head(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 prescriptions with interactions; the head is the feature."""
    rows = rx(spark, d).where(F.col("has_interaction") & (F.size("interactions") > 0))
    return rows.select("prescription_id", F.size("interactions").alias("n")).orderBy("prescription_id").limit(50)


@query(f"WITH {REF}, c AS (SELECT name AS text, 0 AS part, name AS k FROM rf UNION ALL SELECT alias, 1, alias FROM al) SELECT text, min(part)::INT AS part FROM c GROUP BY text")
def corpus_concat(spark: SparkSession, d: str) -> DataFrame:
    """Generic names, then aliases, each text once at its first place."""
    both = generics(spark, d).select(F.col("name").alias("text"), F.lit(0).alias("part")).unionByName(aliases(spark, d).select(F.col("alias").alias("text"), F.lit(1).alias("part")))
    return both.groupBy("text").agg(F.min("part").alias("part"))


@query("WITH r AS (SELECT * FROM keyword_smoke10 QUALIFY row_number() OVER (PARTITION BY prescription_id ORDER BY loaded_at DESC) = 1), p AS (SELECT prescription_id, drugs, unnest(interactions) AS x FROM r) SELECT prescription_id, bool_or(list_has_any(drugs, [x.drug_a, x.drug_b])) AS overlap, max(len(list_intersect(drugs, [x.drug_a, x.drug_b])))::INT AS shared FROM p WHERE drugs IS NOT NULL GROUP BY 1")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = rx(spark, d).where("drugs is not null").select("prescription_id", "drugs", F.explode("interactions").alias("x"))
    two = F.array("x.drug_a", "x.drug_b")
    return p.groupBy("prescription_id").agg(F.bool_or(F.coalesce(F.arrays_overlap("drugs", two), F.lit(False))).alias("overlap"), F.max(F.size(F.array_intersect("drugs", two))).alias("shared"))


@query("SELECT id, arg_min(agentA, (round_no, labelled_at, coalesce(agentA, ''))) AS first_label, arg_max(agentA, (round_no, labelled_at, coalesce(agentA, ''))) AS last_label FROM conflicts WHERE agentA IS NOT NULL GROUP BY id")
def first_last_wins(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("round_no", "labelled_at", F.coalesce("agentA", F.lit("")))
    return table(spark, d, "conflicts").where("agentA is not null").groupBy("id").agg(F.min_by("agentA", order).alias("first_label"), F.max_by("agentA", order).alias("last_label"))


@query("SELECT count(DISTINCT s_name) AS suppliers, count(DISTINCT s_nationkey) AS nations, count(DISTINCT p_brand) AS brands, count(*) FILTER (p_size >= 25) AS large FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def distinct_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.agg(F.count_distinct("s_name").alias("suppliers"), F.count_distinct("s_nationkey").alias("nations"), F.count_distinct("p_brand").alias("brands"), F.count_if(F.col("p_size") >= 25).alias("large"))
