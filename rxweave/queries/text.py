"""Cleaning, candidates, dictionary scans, noise and encodings of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scan
from ..sources.tables import table
from .registry import PR, RX, query, rx, rx_pairs, strip_sql


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Distinct drug entries as written."""
    return table(spark, d, "keyword_smoke10").select(F.explode("drugs").alias("entered")).where("entered is not null").distinct()


ENTRIES = "en AS (SELECT DISTINCT entered FROM (SELECT unnest(drugs) AS entered FROM keyword_smoke10) WHERE entered IS NOT NULL)"
# Mentions made of part names, brands and line quantities: plain ASCII, so that both engines' word boundaries agree.
MENTIONS = "mn AS (SELECT DISTINCT p_name || ' ' || upper(substr(p_type, 1, 2)) || ' ' || (l_quantity::INT * 10) || CASE l_linenumber % 3 WHEN 0 THEN 'mgBD' WHEN 1 THEN ' mg TAB' ELSE ' (sr) twice daily!' END AS mention FROM lineitem JOIN part ON l_partkey = p_partkey)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tail = F.when(F.col("l_linenumber") % 3 == 0, "mgBD").when(F.col("l_linenumber") % 3 == 1, " mg TAB").otherwise(" (sr) twice daily!")
    dose = (F.col("l_quantity").cast("int") * 10).cast("string")
    return rows.select(F.concat("p_name", F.lit(" "), F.upper(F.substring("p_type", 1, 2)), F.lit(" "), dose, tail).alias("mention")).distinct()


def presplit_sql(t: str) -> str:
    u = T.UNITS
    first = f"regexp_replace({t}, '([a-zA-Z])(\\d+(\\.\\d+)?\\s?({u}|%))', '\\1 \\2', 'gi')"
    return f"regexp_replace({first}, '(\\d+(\\.\\d+)?({u}|%))([a-zA-Z]{{1,3}})', '\\1 \\4', 'gi')"


def clean_sql(t: str) -> str:
    out = presplit_sql(f"lower(trim({t}))")
    for p in ("[()\\[\\]{}]", "[^\\w\\s\\-/+&]", f"\\b\\d+(\\.\\d+)?\\s?({T.UNITS}|%|w/v|v/v)\\b", f"\\b({T.FORMS})\\b", f"\\b({T.FREQUENCIES})\\b", f"\\b({T.MODIFIERS})\\b", "\\b\\d+(\\.\\d+)?\\b"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"WITH {MENTIONS} SELECT mention, {clean_sql('mention')} AS cleaned FROM mn")
def clean_mention(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).select("mention", T.clean_mention(F.col("mention")).alias("cleaned"))


@query(f"WITH {RX} SELECT prescription_id, {presplit_sql('prescription_text')} AS presplit FROM rx")
def glued_presplit(spark: SparkSession, d: str) -> DataFrame:
    return rx(spark, d).select("prescription_id", T.glued_presplit(F.col("prescription_text")).alias("presplit"))


COMBO = "cb AS (SELECT DISTINCT p_name || CASE p_size % 5 WHEN 0 THEN '/' || p_brand WHEN 1 THEN ' and ' || p_type WHEN 2 THEN '-H' WHEN 3 THEN '-Plus' ELSE '' END AS mention FROM part), known AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size < 25)"


@query(
    f"""WITH {COMBO}, s AS (SELECT mention, list_filter(list_transform(string_split_regex(lower(trim(mention)), '{T.DELIMITER}'), lambda p: trim(p)), lambda p: p <> '') AS parts,
    regexp_extract(lower(trim(mention)), '^(.+)[-_](am|h|m|d|plus|ls|ln)$', 1) AS stem, regexp_extract(lower(trim(mention)), '^(.+)[-_](am|h|m|d|plus|ls|ln)$', 2) AS suffix FROM cb)
SELECT mention, CASE WHEN len(parts) > 1 THEN parts WHEN k.name IS NOT NULL AND suffix IN ('plus', 'ls', 'ln') THEN [stem]
    WHEN k.name IS NOT NULL AND suffix <> '' THEN [stem, CASE suffix WHEN 'am' THEN 'amlodipine' WHEN 'h' THEN 'hydrochlorothiazide' WHEN 'm' THEN 'metformin' ELSE 'domperidone' END] ELSE [lower(trim(mention))] END AS fragments
FROM s LEFT JOIN known k ON k.name = stem"""
)
def combo_split(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    size = F.col("p_size") % 5
    tail = F.when(size == 0, F.concat(F.lit("/"), "p_brand")).when(size == 1, F.concat(F.lit(" and "), "p_type")).when(size == 2, "-H").when(size == 3, "-Plus").otherwise("")
    rows = part.select(F.concat("p_name", tail).alias("mention")).distinct()
    known = part.where("p_size < 25").select(F.lower("p_name").alias("name")).distinct()
    return scan.split_combos(rows, known)


N_MAX = 2
TOKENS = f"""{RX}, tk AS (SELECT prescription_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(prescription_text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM rx),
grams AS (SELECT prescription_id, n, i, ws[i:i + n - 1] AS words FROM tk, range(1, 3) a(n), range(1, 400) b(i) WHERE i + n - 1 <= len(ws))"""
STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    f"""WITH {TOKENS}, c AS (SELECT prescription_id, n, i, array_to_string(words, ' ') AS candidate FROM grams WHERE len(list_filter(words, lambda w: w IN ('and', 'with', 'plus', 'or'))) = 0
    AND len(array_to_string(words, ' ')) >= 3 AND len(list_filter(words, lambda w: w NOT IN ({STOPS}))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY prescription_id ORDER BY n, i) AS rn FROM c) SELECT prescription_id, n::INT AS n, (i - 1)::INT AS at, candidate FROM r WHERE rn <= 600"""
)
def ngram_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Word 1- and 2-grams that may be a name, at most 600 a record: all single words first."""
    rows = rx(spark, d).select("prescription_id", scan.tokens(F.col("prescription_text")).alias("ws"))
    return scan.candidates(rows, "prescription_id", "ws", 600)


@query(
    f"""WITH {TOKENS}, keys AS (SELECT DISTINCT lower(drug_name) AS k FROM drug_reference), hits AS (SELECT prescription_id, (i - 1)::INT AS "at", n::INT AS n, array_to_string(words, ' ') AS name FROM grams WHERE array_to_string(words, ' ') IN (SELECT k FROM keys))
SELECT prescription_id, "at", n, name FROM hits"""
)
def dictionary_match(spark: SparkSession, d: str) -> DataFrame:
    """Names of the drug list in each prescription text: word n-grams joined to the list, longest first, no overlaps."""
    rows = rx(spark, d).select("prescription_id", scan.tokens(F.col("prescription_text")).alias("ws"))
    keys = table(spark, d, "drug_reference").select(F.lower("drug_name").alias("key"))
    return scan.dictionary(rows, "prescription_id", "ws", keys).select("prescription_id", "at", "n", F.col("key").alias("name"))


# Patterns of the fallback recogniser; only names mind the case. DuckDB's word boundaries know ASCII
# letters only, so the statement puts a sign that it takes for a letter in place of all others; none is ever matched.
NER = {
    "MEDICATION": "\\b[A-Z][a-z]+(?:\\s+\\d+(?:mg|mcg|g|ml)?)?\\b",
    "DOSAGE": "(?i)\\b\\d+(?:\\.\\d+)?\\s*(?:mg|mcg|g|ml|tablets?|capsules?)\\b",
    "FREQUENCY": "(?i)\\b(?:once|twice|thrice|\\d+\\s*times?)\\s+(?:daily|per day|a day)\\b",
}


@query(
    f"""WITH {RX}, m AS ({" UNION ALL ".join(f"SELECT prescription_id, '{k}' AS label, regexp_extract_all(regexp_replace(prescription_text, '[µªºÀ-ÖØ-öø-ʯЀ-ӿऀ-ॿ]', '_', 'g'), '{p}') AS found FROM rx" for k, p in NER.items())})
SELECT prescription_id, label, pos::INT AS pos, found[pos + 1] AS text, 0.5::DOUBLE AS confidence FROM m, range(0, 200) r(pos) WHERE pos < len(found)"""
)
def regex_ner(spark: SparkSession, d: str) -> DataFrame:
    """Names, doses and frequencies by pattern, with confidence 0.5."""
    rows = rx(spark, d).select("prescription_id", "prescription_text")
    found = F.array(*(F.struct(F.lit(k).alias("label"), F.regexp_extract_all("prescription_text", F.lit(p), 0).alias("texts")) for k, p in NER.items()))
    each = rows.where("prescription_text is not null").select("prescription_id", F.explode(found).alias("f"))
    return each.select("prescription_id", "f.label", F.posexplode("f.texts").alias("pos", "text")).withColumn("confidence", F.lit(0.5))


@query(
    f"""WITH {ENTRIES}, w AS (SELECT entered, lower(trim(entered, ' ')) AS low, len(trim(entered, ' ')) AS n, string_split(trim(regexp_replace(lower(trim(entered, ' ')), '\\s+', ' ', 'g'), ' '), ' ') AS ws FROM en)
SELECT entered, n >= 2 AND low NOT IN ({STOPS}) AND len(list_filter(ws, lambda x: x NOT IN ({STOPS}))) > 0 AND NOT regexp_matches(low, '^\\d+$') AS valid FROM w"""
)
def entity_valid(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("entered", T.valid_entity(F.col("entered")).alias("valid"))


@query(
    """WITH keys AS (SELECT DISTINCT n_name AS key FROM nation UNION SELECT DISTINCT substr(n_name, 1, 2) FROM nation UNION SELECT 'no' UNION SELECT 'IN'),
routed AS (SELECT key, CASE WHEN len(key) <= 2 AND lower(key) IN ('no', 'in', 'is', 'me', 'up', 'so', 'it', 'as', 'or', 'an', 'of', 'to', 'on', 'at', 'by', 'do', 'be', 'if', 'we', 'he', 'my', 'mg', 'ml') THEN 'dropped' WHEN len(key) <= 2 THEN 'case_sensitive' ELSE 'case_insensitive' END AS route FROM keys)
SELECT route, key, count(c_custkey) AS hits FROM routed LEFT JOIN customer ON (route = 'case_sensitive' AND substr(c_mktsegment, 1, 2) = key) OR (route = 'case_insensitive' AND lower(c_mktsegment) = lower(key)) GROUP BY ALL"""
)
def short_key_routing(spark: SparkSession, d: str) -> DataFrame:
    """Keys of up to two letters match case-sensitively and never as stopwords; longer ones regardless of case."""
    names = table(spark, d, "nation").select("n_name")
    keys = names.select(F.explode(F.array(F.col("n_name"), F.substring("n_name", 1, 2), F.lit("no"), F.lit("IN"))).alias("key")).distinct()
    route = F.when((F.length("key") <= 2) & F.lower("key").isin(*[w for w in T.STOPWORDS if len(w) == 2]), "dropped").when(F.length("key") <= 2, "case_sensitive").otherwise("case_insensitive")
    routed = keys.select("key", route.alias("route"))
    said = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    exact = said.groupBy(F.lit("case_sensitive").alias("route"), F.substring("c_mktsegment", 1, 2).alias("m")).agg(F.sum("n").alias("n"))
    folded = said.groupBy(F.lit("case_insensitive").alias("route"), F.lower("c_mktsegment").alias("m")).agg(F.sum("n").alias("n"))
    wanted = routed.withColumn("m", F.when(F.col("route") == "case_insensitive", F.lower("key")).otherwise(F.col("key")))
    return wanted.join(exact.unionByName(folded), ["route", "m"], "left").select("route", "key", F.coalesce("n", F.lit(0)).alias("hits"))


@query("WITH m AS (SELECT DISTINCT p_name || ', ' || p_brand || '!  (' || p_type || ')' AS raw FROM part) SELECT raw, trim(regexp_replace(regexp_replace(lower(raw), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM m")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").select(F.concat("p_name", F.lit(", "), "p_brand", F.lit("!  ("), "p_type", F.lit(")")).alias("raw")).distinct()
    return raw.select("raw", T.normalize_text(F.col("raw")).alias("normalized"))


@query("WITH m AS (SELECT DISTINCT ' ##' || replace(p_name, ' ', '_') || ' .;' || p_size AS raw FROM part) SELECT raw, trim(trim(regexp_replace(replace(replace(raw, '##', ''), '_', ' '), '\\s+', ' ', 'g')), ' ,.;:-') AS cleaned FROM m")
def entity_cleanup(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").select(F.concat(F.lit(" ##"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" .;"), F.col("p_size").cast("string")).alias("raw")).distinct()
    return raw.select("raw", T.clean_entity_text(F.col("raw")).alias("cleaned"))


TAGS = ("B-DRUG", "I-CHEM", "TREATMENT", "b-medication", "DOSE", "B-DOSE_UNIT", "FREQ", "DURATION", "ROUTE", "DISEASE", "B-SYMPTOM", "", "O", "LAB")


@query(
    f"""WITH g AS (SELECT CASE event_id % {len(TAGS)} {" ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TAGS))} END AS tag FROM events),
t AS (SELECT tag, regexp_replace(trim(upper(tag)), '^[BI]-', '') AS u FROM g)
SELECT tag, CASE WHEN tag = '' THEN 'UNKNOWN' WHEN regexp_matches(u, 'DRUG|CHEM|MED|^TREATMENT$') THEN 'MEDICATION' WHEN contains(u, 'DOSE') THEN 'DOSAGE' WHEN contains(u, 'FREQ') THEN 'FREQUENCY' WHEN contains(u, 'DUR') THEN 'DURATION'
    WHEN contains(u, 'ROUTE') THEN 'ROUTE' WHEN regexp_matches(u, 'DISEASE|CONDITION|SYMPTOM') THEN 'CONDITION' ELSE u END AS label, count(*) AS n FROM t GROUP BY ALL"""
)
def tag_normalize(spark: SparkSession, d: str) -> DataFrame:
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("event_id") % len(TAGS) + 1).cast("int"))
    return table(spark, d, "events").select(tag.alias("tag")).groupBy("tag", T.entity_tag(F.col("tag")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_brand || '-x9y ' || p_name AS raw, array_to_string(list_transform(regexp_extract_all(lower(p_brand || '-x9y ' || p_name), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') AS titled FROM part")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").select(F.concat("p_brand", F.lit("-x9y "), "p_name").alias("raw")).distinct()
    return raw.select("raw", T.title_case(F.col("raw")).alias("titled"))


KEYS = "ky AS (SELECT DISTINCT replace(p_name, ' ', '-') || CASE p_size % 4 WHEN 0 THEN '-xl' WHEN 1 THEN '-650' WHEN 2 THEN '-h' ELSE ' SR  xr' END AS token FROM part)"


def keys(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 4
    tail = F.when(size == 0, "-xl").when(size == 1, "-650").when(size == 2, "-h").otherwise(" SR  xr")
    return table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), tail).alias("token")).distinct()


COLLAPSE = "regexp_replace(array_to_string(list_filter(string_split_regex(lower(trim(token)), '[-_\\s]+'), lambda p: p <> '' AND NOT regexp_matches(p, '^\\d+(\\.\\d+)?[a-z]{0,3}$')), '-'), '([^-])(-(xl|xr|sr|er|cr|ds|odt|la|pr))+$', '\\1')"


@query(f"WITH {KEYS} SELECT token, {COLLAPSE} AS key FROM ky")
def collapse_token(spark: SparkSession, d: str) -> DataFrame:
    return keys(spark, d).select("token", T.collapse_token(F.col("token")).alias("key"))


@query(f"WITH {KEYS}, c AS (SELECT DISTINCT {COLLAPSE} AS key FROM ky) SELECT key, array_to_string(list_transform(string_split(key, '-'), lambda p: upper(p[1]) || p[2:]), '-') AS pretty FROM c")
def prettify(spark: SparkSession, d: str) -> DataFrame:
    return keys(spark, d).select(T.collapse_token(F.col("token")).alias("key")).distinct().select("key", T.prettify(F.col("key")).alias("pretty"))


@query(f"WITH {KEYS}, c AS (SELECT DISTINCT {COLLAPSE} AS key FROM ky) SELECT key, list_slice(list_sort(list_distinct([key, replace(key, '-', ' '), replace(key, '-', ''), replace(key, ' ', '-'), replace(key, ' ', '')])), 1, 10) AS variants FROM c")
def variants_slice(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of a key: distinct, sorted, at most ten (the feature)."""
    return keys(spark, d).select(T.collapse_token(F.col("token")).alias("key")).distinct().select("key", F.slice(T.surface_forms(F.col("key")), 1, 10).alias("variants"))


PRODUCTS = "pt AS (SELECT DISTINCT p_name || ' ' || p_size || CASE p_size % 3 WHEN 0 THEN ' mg Tablet' WHEN 1 THEN ' Capsules' ELSE ' (steel) mcg syrup' END AS product FROM part)"
BRAND = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\([^)]*\\)', ' ', 'g'), '\\b\\d+(\\.\\d+)?\\s*(mg|g|mcg|ug|ml|l|iu|units?|meq|mmol|%)?\\b', ' ', 'g'), '\\b(tablet|capsules|syrup|mcg|mg)\\b', ' ', 'g'))"


@query(f"WITH {PRODUCTS} SELECT product, trim(regexp_replace({BRAND.format('lower(product)')}, '\\s+', ' ', 'g'), ' -/') AS brand FROM pt")
def brand_token(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 3
    tail = F.when(size == 0, " mg Tablet").when(size == 1, " Capsules").otherwise(" (steel) mcg syrup")
    rows = table(spark, d, "part").select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), tail).alias("product")).distinct()
    return rows.select("product", T.brand_token(F.col("product")).alias("brand"))


TYPOS = (("red", "rde"), ("small", "smal"), ("widget", "wigdet"), ("plate", "plaet"), ("blue", "bleu"))


def typo_sql(t: str) -> str:
    for a, b in TYPOS:
        t = f"replace({t}, '{a}', '{b}')"
    return t


@query(f"SELECT DISTINCT p_name, {typo_sql('p_name')} AS typo FROM part")
def typo_map(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in TYPOS))
    return table(spark, d, "part").select("p_name").distinct().select("p_name", T.replace_all(F.col("p_name"), pairs).alias("typo"))


ERRORS = "er AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'retryDelay: \"' || value || 's\"' WHEN 1 THEN '429 RESOURCE_EXHAUSTED. please retry in ' || value || 's.' WHEN 2 THEN 'CUDA out of memory, limit: 0' ELSE '' END AS msg FROM events)"


@query(
    f"""WITH {ERRORS}, x AS (SELECT event_id, msg, coalesce(nullif(regexp_extract(msg, 'retryDelay[''"]?\\s*:\\s*[''"]([0-9]+(\\.[0-9]+)?)s[''"]', 1), ''), nullif(regexp_extract(msg, '(?i)Please retry in\\s+([0-9]+(\\.[0-9]+)?)s', 1), '')) AS v FROM er)
SELECT event_id, (CASE WHEN v IS NULL THEN 2.0 ELSE greatest(v::DOUBLE, 0.2) END)::DOUBLE AS delay, contains(upper(msg), 'RESOURCE_EXHAUSTED') OR contains(upper(msg), 'QUOTA EXCEEDED') AS exhausted, contains(lower(msg), 'limit: 0') AS zero_quota, contains(lower(msg), 'out of memory') AS oom FROM x"""
)
def retry_delay_parse(spark: SparkSession, d: str) -> DataFrame:
    kind, value = F.col("event_id") % 4, F.col("value").cast("string")
    msg = F.when(kind == 0, F.concat(F.lit('retryDelay: "'), value, F.lit('s"'))).when(kind == 1, F.concat(F.lit("429 RESOURCE_EXHAUSTED. please retry in "), value, F.lit("s."))).when(kind == 2, "CUDA out of memory, limit: 0").otherwise("")
    rows = table(spark, d, "events").select("event_id", msg.alias("msg"))
    m = F.col("msg")
    return rows.select("event_id", T.retry_delay(m).alias("delay"), T.quota_exhausted(m).alias("exhausted"), F.lower(m).contains("limit: 0").alias("zero_quota"), T.out_of_memory(m).alias("oom"))


@query("WITH m AS (SELECT DISTINCT 'A ' || lower(agentA) || ' or very  severe case, not mildly so' AS raw FROM conflicts WHERE agentA IS NOT NULL) SELECT raw, regexp_replace(raw, '\\b(Mild|Severe|VERY\\s+SEVERE)\\b', 'interaction risk', 'gi') AS scrubbed FROM m")
def reasoning_scrub(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "conflicts").where("agentA is not null").select(F.concat(F.lit("A "), F.lower("agentA"), F.lit(" or very  severe case, not mildly so")).alias("raw")).distinct()
    return raw.select("raw", T.scrub_reasoning(F.col("raw")).alias("scrubbed"))


@query("WITH m AS (SELECT DISTINCT 'org/' || CASE p_size % 3 WHEN 0 THEN 'granite-embedding-' WHEN 1 THEN 'embeddinggemma-' ELSE 'SapBERT-from-PubMedBERT-fulltext-' END || replace(p_name, ' ', '-') AS model FROM part) SELECT model, replace(replace(replace(string_split(model, '/')[-1], 'granite-embedding-', 'granite-'), 'embeddinggemma', 'gemma'), '-from-PubMedBERT-fulltext', '') AS short FROM m")
def short_model_name(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 3
    kind = F.when(size == 0, "granite-embedding-").when(size == 1, "embeddinggemma-").otherwise("SapBERT-from-PubMedBERT-fulltext-")
    rows = table(spark, d, "part").select(F.concat(F.lit("org/"), kind, F.replace("p_name", F.lit(" "), F.lit("-"))).alias("model")).distinct()
    return rows.select("model", T.short_model_name(F.col("model")).alias("short"))


FENCED = "fn AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || '{\"labels\": [' || event_id % 4 || ', ' || event_id % 3 || ']}' || chr(10) || '```' WHEN 1 THEN '{\"labels\": [' || event_id % 5 || ']}' ELSE 'no json' END AS raw FROM events)"


@query(f"WITH {FENCED}, s AS (SELECT event_id, trim(regexp_replace(raw, '^```(json)?\\s*|\\s*```$', '', 'g')) AS js FROM fn) SELECT event_id, CASE WHEN json_valid(js) THEN from_json(json_extract(js, '$.labels'), '[\"INTEGER\"]') END AS labels FROM s")
def llm_json_parse(spark: SparkSession, d: str) -> DataFrame:
    kind, n = F.col("event_id") % 3, F.col("event_id")
    two = F.format_string("```json\n{\"labels\": [%d, %d]}\n```", n % 4, n % 3)
    raw = F.when(kind == 0, two).when(kind == 1, F.format_string('{"labels": [%d]}', n % 5)).otherwise("no json")
    rows = table(spark, d, "events").select("event_id", T.strip_fences(raw).alias("js"))
    return rows.select("event_id", F.from_json("js", "labels array<int>")["labels"].alias("labels"))


WORDS = f"{PR}, dt AS (SELECT DISTINCT text_id, drugbank_description AS description FROM pr), ws AS (SELECT text_id, unnest(string_split_regex(lower(description), '[^a-z0-9]+')) AS w FROM dt WHERE description IS NOT NULL), vc AS (SELECT w, count(*) AS n FROM ws WHERE w <> '' GROUP BY 1)"


def description_words(spark: SparkSession, d: str) -> DataFrame:
    texts = rx_pairs(spark, d).select("text_id", F.col("drugbank_description").alias("description")).distinct()
    return texts.select("text_id", F.posexplode(F.split(F.lower("description"), "[^a-z0-9]+")).alias("at", "w")).where("w != ''")


@query(f"WITH {WORDS} SELECT w, n, (row_number() OVER (ORDER BY n DESC, w) + 1)::INT AS id FROM vc QUALIFY row_number() OVER (ORDER BY n DESC, w) <= 1998")
def vocab_build(spark: SparkSession, d: str) -> DataFrame:
    """The 1,998 most frequent words with ids from 2; 0 is padding, 1 unknown. The size is the feature."""
    return scan.vocabulary(description_words(spark, d), "w", 2000)


@query(f"WITH {WORDS}, v AS (SELECT w, (row_number() OVER (ORDER BY n DESC, w) + 1)::INT AS id FROM vc QUALIFY row_number() OVER (ORDER BY n DESC, w) <= 1998) SELECT text_id, list_transform(list_filter(string_split_regex(lower(description), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: coalesce(m[x], 1)) AS ids FROM dt, (SELECT map_from_entries(list((w, id))) AS m FROM v) WHERE description IS NOT NULL AND regexp_matches(description, '[A-Za-z0-9]')")
def token_encode(spark: SparkSession, d: str) -> DataFrame:
    """Texts as word ids; an unknown word is 1."""
    tokens = description_words(spark, d)
    return scan.encode(tokens, "text_id", "w", "at", scan.vocabulary(tokens, "w", 2000))


@query(
    f"""WITH {TOKENS}, english AS (SELECT w FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS w FROM documents WHERE lang = 'en') GROUP BY w HAVING count(*) >= 5)
SELECT DISTINCT g.prescription_id, g.n::INT AS n, (g.i - 1)::INT AS at, array_to_string(g.words, ' ') AS candidate FROM (SELECT *, unnest(words) AS w FROM grams) g WHERE NOT EXISTS (SELECT 1 FROM english e WHERE e.w = g.w)"""
)
def english_word_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with at least one word that is not ordinary English, by a word list from the documents."""
    english = table(spark, d, "documents").where("lang = 'en'").select(F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("w")).groupBy("w").count().where("count >= 5").select("w")
    rows = rx(spark, d).select("prescription_id", scan.tokens(F.col("prescription_text")).alias("ws"))
    grams = scan.grams(rows, "prescription_id", "ws", N_MAX)
    single = grams.select("prescription_id", "n", "at", "words", F.explode("words").alias("w")).join(english, "w", "left_anti")
    return single.select("prescription_id", "n", "at", F.array_join("words", " ").alias("candidate")).distinct()


BLANK_SQL = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
NOISE_ITEMS = f"""{RX}, base AS (SELECT prescription_id, prescription_text AS text,
    list_sort(list_distinct(list_transform(list_filter(coalesce(drugs, []), lambda x: x <> ''), lambda x: printf('%06d', 100000 - len(x)) || lower(x)))) AS keyed FROM rx WHERE prescription_text IS NOT NULL),
named AS (SELECT prescription_id, text, list_transform(keyed, lambda x: x[7:]) AS names FROM base)"""
L2_SQL = f"""replace(replace(regexp_replace(list_reduce(list_prepend(lower(text), names), lambda t, s: regexp_replace(t, regexp_escape(s) || '{BLANK_SQL}+([0-9])', s || '\\1', 'g')),
    '([a-z]){BLANK_SQL}+(\\d+{BLANK_SQL}*(mg|mcg|g|ml|iu)\\b)', '\\1\\2', 'g'), 'daily', 'daiIy'), 'vitamin', 'v1tam1n')"""


@query(f"WITH {NOISE_ITEMS} SELECT prescription_id, {L2_SQL} AS text FROM named")
def noise_l2(spark: SparkSession, d: str) -> DataFrame:
    """Lower case, doses glued to the prescription's names and to any word before, two scanner confusions."""
    return rx(spark, d).where("prescription_text is not null").select("prescription_id", scan.noise_glued(F.col("prescription_text"), F.col("drugs")).alias("text"))


# Spoken openings.
PREFIXES = ("bukhar ke liye ", "dard ke liye ", "doctor ne likha hai: ", "bukhar aur dard ke liye ")
PREFIX_SQL = f"[{', '.join(repr(p) for p in PREFIXES)}][('0x' || substr(md5(prescription_id::VARCHAR), 1, 8))::BIGINT % 4 + 1]"
L3_TABLES = f"""{NOISE_ITEMS}, whole AS (SELECT prescription_id, names, {PREFIX_SQL} || regexp_replace(text, '\\s*\\b\\d+(\\.\\d+)?\\s*(mg|mcg|µg|ug|g|ml|iu|units?|%)\\b', '', 'gi') AS text FROM named),
lines AS (SELECT prescription_id, k, ls[k] AS line, coalesce(list_max(list_transform(names, lambda s: CASE WHEN contains(lower(ls[k]), s) THEN strpos(lower(ls[k]), s) - 1 + len(s) ELSE 0 END)), 0) AS e
    FROM (SELECT prescription_id, names, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT prescription_id, names, string_split(text, chr(10)) AS ls FROM whole))),
tails AS (SELECT *, list_filter(string_split_regex(line[e + 1:], '{BLANK_SQL}+'), lambda w: w <> '') AS tail FROM lines),
cut AS (SELECT prescription_id, string_agg(CASE WHEN len(tail) > 3 THEN line[1:e] || array_to_string(tail[1:3], ' ') || ' ...' ELSE line END, chr(10) ORDER BY k) AS cut FROM tails GROUP BY 1),
l3 AS (SELECT prescription_id, CASE WHEN len(list_filter(names, lambda s: NOT contains(lower(cut), s))) > 0 THEN text ELSE cut END AS text FROM whole JOIN cut USING (prescription_id))"""


@query(f"WITH {L3_TABLES} SELECT prescription_id, text FROM l3")
def noise_l3(spark: SparkSession, d: str) -> DataFrame:
    """A spoken opening, chosen by the id's hash, all doses dropped, and lines cut three words behind their last name."""
    rows = rx(spark, d).where("prescription_text is not null")
    return rows.select("prescription_id", scan.noise_dropped(F.col("prescription_id"), F.col("prescription_text"), F.col("drugs"), PREFIXES).alias("text"))


L1_TABLES = f"""{RX}, base AS (SELECT prescription_id, prescription_text AS text FROM rx WHERE prescription_text IS NOT NULL),
sites AS (SELECT prescription_id, i AS place, CASE WHEN substr(text, i, 2) = 'rn' THEN 2 ELSE 1 END AS n, CASE WHEN substr(text, i, 2) = 'rn' THEN 'm' WHEN substr(text, i, 1) = 'e' THEN 'c' ELSE 'O' END AS r
    FROM base, range(1, 3000) q(i) WHERE i <= len(text) AND (substr(text, i, 1) IN ('e', '0') OR substr(text, i, 2) = 'rn')),
pick AS (SELECT * FROM sites QUALIFY row_number() OVER (PARTITION BY prescription_id ORDER BY md5(prescription_id || '|' || place), place) <= 2),
ends AS (SELECT prescription_id, min_by(r, place) AS r1, min(place) AS p1, min_by(n, place) AS n1, max_by(r, place) AS r2, max(place) AS p2, max_by(n, place) AS n2 FROM pick GROUP BY 1),
l1 AS (SELECT prescription_id, CASE WHEN p1 IS NULL THEN text WHEN p1 = p2 THEN substr(text, 1, p1 - 1) || r1 || substr(text, p1 + n1)
    ELSE substr(text, 1, p1 - 1) || r1 || substr(text, p1 + n1, p2 - p1 - n1) || r2 || substr(text, p2 + n2) END AS text FROM base LEFT JOIN ends USING (prescription_id))"""


@query(f"WITH {L1_TABLES} SELECT prescription_id, text FROM l1")
def noise_l1(spark: SparkSession, d: str) -> DataFrame:
    """Up to two confusions (e to c, rn to m, 0 to O) at places chosen by hash."""
    return rx(spark, d).where("prescription_text is not null").select("prescription_id", scan.noise_letters(F.col("prescription_id"), F.col("prescription_text")).alias("text"))


@query(
    f"""WITH {L3_TABLES}, {L1_TABLES.split("base AS", 1)[1].split("),", 1)[1].strip().replace("base", "named")}
SELECT 'L2' AS level, prescription_id, len({L2_SQL})::INT AS chars FROM named UNION ALL SELECT 'L3', prescription_id, len(text)::INT FROM l3 UNION ALL SELECT 'L1', prescription_id, len(text)::INT FROM l1"""
)
def noise_union(spark: SparkSession, d: str) -> DataFrame:
    """All three levels of noise as one table."""
    parts = [f(spark, d).select(F.lit(level).alias("level"), "prescription_id", F.length("text").alias("chars")) for level, f in (("L1", noise_l1), ("L2", noise_l2), ("L3", noise_l3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {RX}, brands AS (SELECT lower(drug_name) AS g, brand_names[1] AS brand FROM drug_reference WHERE len(brand_names) > 0),
it AS (SELECT prescription_id, lower({strip_sql("drug")}) AS g, min(ord) AS ord FROM (SELECT prescription_id, unnest(drugs) AS drug, unnest(range(len(drugs))) AS ord FROM rx) WHERE drug IS NOT NULL GROUP BY ALL),
subs AS (SELECT prescription_id, count(*) AS substituted, list_sort(list(printf('%06d', 100000 - len(g)) || g || chr(1) || brand)) AS subs FROM it JOIN brands USING (g) GROUP BY 1)
SELECT prescription_id, coalesce(substituted, 0) AS substituted, list_reduce(list_prepend(prescription_text, coalesce(subs, [])), lambda t, s: regexp_replace(t, '(?i)\\b' || regexp_escape(split_part(s[7:], chr(1), 1)) || '([^A-Za-z]|$)', split_part(s, chr(1), 2) || '\\1', 'g')) AS text FROM rx LEFT JOIN subs USING (prescription_id)"""
)
def brand_substitute(spark: SparkSession, d: str) -> DataFrame:
    """Prescription texts with the first brand in place of every name that has one, and how many names were."""
    return scan.brand_texts(rx(spark, d), table(spark, d, "drug_reference")).select("prescription_id", "substituted", "text")
