"""Pair enumeration, knowledge-base lookups, pair matching, per-record roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity as S
from ..functions.text import name_key, stripped
from ..operators import metrics as M
from ..operators import pairs as P
from ..sources.tables import table
from .registry import EV, PR, RX, evals, key_sql, query, r6, rx, rx_pairs, strip_sql

# severity_rank in SQL, for labels that are already one of the four outcomes or null
RANK = "CASE {0} WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Mild' THEN 1 ELSE 0 END"
LABEL = "CASE {0} WHEN 3 THEN 'Severe' WHEN 2 THEN 'Moderate' WHEN 1 THEN 'Mild' ELSE 'No Interaction' END"


def order_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of an order: distinct part names, numbered in a fixed order."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name", "p_type")
    first = lines.groupBy("l_orderkey", "p_name").agg(F.min(F.struct("l_linenumber", "p_type")).alias("m"))
    return first.select("l_orderkey", "p_name", F.col("m.p_type").alias("p_type"), F.concat(F.lpad(F.col("m.l_linenumber").cast("string"), 6, "0"), F.lit("|"), "p_name").alias("ord"))


ITEMS = """items AS (SELECT l_orderkey, p_name, min(lpad(l_linenumber::VARCHAR, 6, '0')) || '|' || p_name AS ord, arg_min(p_type, (l_linenumber, p_type)) AS p_type
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_name)"""


@query(f"WITH {ITEMS} SELECT a.l_orderkey, a.p_name AS first, b.p_name AS second FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.ord < b.ord")
def pair_enumeration(spark: SparkSession, d: str) -> DataFrame:
    return P.enumerate_pairs(order_items(spark, d), "l_orderkey", "p_name", "ord").select("l_orderkey", "first", "second")


def kb_edges(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base that the prescriptions carry: one directed edge per text, ids from the drug list."""
    ids = table(spark, d, "drug_reference").select(F.col("drug_name").alias("n"), F.concat(F.lit("D"), F.col("drug_id").cast("string")).alias("i"))
    texts = rx_pairs(spark, d).groupBy("text_id").agg(F.min("drug_a").alias("drug_a"), F.min("drug_b").alias("drug_b"), F.min("drugbank_description").alias("drugbank_description"), F.min("drugbank_id").alias("drugbank_id"))
    with_ids = texts.join(ids.select(F.col("n").alias("drug_a"), F.col("i").alias("source_id")), "drug_a", "left")
    return with_ids.select(F.col("drug_a").alias("source"), "source_id", F.col("drug_b").alias("target"), F.col("drugbank_id").alias("target_id"), F.col("drugbank_description").alias("description"), F.col("text_id").alias("pos"))


KB = PR + f""", texts AS (SELECT text_id, min(drug_a) AS drug_a, min(drug_b) AS drug_b, min(drugbank_description) AS d, min(drugbank_id) AS i FROM pr GROUP BY text_id),
edges AS (SELECT t.drug_a AS source, 'D' || r.drug_id AS source_id, t.drug_b AS target, t.i AS target_id, t.d AS description, t.text_id AS pos FROM texts t LEFT JOIN drug_reference r ON r.drug_name = t.drug_a),
idx AS (SELECT {key_sql('source')} AS src_key, 'name' AS key_kind, target, description, target_id, pos FROM edges WHERE {strip_sql('source')} <> ''
    UNION ALL SELECT {key_sql('source_id')}, 'id', target, description, target_id, pos FROM edges WHERE {strip_sql('source_id')} <> '')"""


@query(f"WITH {KB} SELECT src_key, key_kind, target, description, target_id, pos FROM idx")
def kb_index_flatten(spark: SparkSession, d: str) -> DataFrame:
    return P.flatten_index(kb_edges(spark, d))


def drug_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of drugs as entered in each prescription, in order."""
    items = rx(spark, d).select("prescription_id", F.posexplode("drugs").alias("ord", "drug")).where(stripped(F.col("drug")) != "")
    return P.enumerate_pairs(items, "prescription_id", "drug", "ord").select("prescription_id", F.col("first").alias("a"), F.col("second").alias("b"), "first_ord", "second_ord")


DRUG_PAIRS = f"""it AS (SELECT prescription_id, ord, drug FROM (SELECT prescription_id, unnest(drugs) AS drug, unnest(range(len(drugs))) AS ord FROM rx) WHERE {strip_sql('drug')} <> ''),
dp AS (SELECT x.prescription_id, x.drug AS a, y.drug AS b, x.ord::INT AS first_ord, y.ord::INT AS second_ord FROM it x JOIN it y ON x.prescription_id = y.prescription_id AND x.ord < y.ord)"""
EDGE1 = f"e1 AS (SELECT src_key, {key_sql('target')} AS tgt, arg_min({{'d': description, 'i': target_id}}, pos) AS e FROM idx WHERE key_kind = 'name' GROUP BY ALL)"


@query(
    f"""WITH {KB}, {DRUG_PAIRS}, {EDGE1}
SELECT prescription_id, a, b, first_ord, second_ord, e.d AS description, e.i AS target_id FROM dp JOIN e1 ON {key_sql('a')} = src_key AND {key_sql('b')} = tgt"""
)
def kb_lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    found = P.lookup(drug_pairs(spark, d), P.flatten_index(kb_edges(spark, d)))
    return found.where("direction = 'forward'").drop("direction")


@query(
    f"""WITH {KB}, {DRUG_PAIRS}, {EDGE1}
SELECT prescription_id, a, b, first_ord, second_ord, coalesce(f.e, r.e).d AS description, coalesce(f.e, r.e).i AS target_id,
    CASE WHEN f.e IS NOT NULL THEN 'forward' WHEN r.e IS NOT NULL THEN 'reverse' END AS direction
FROM dp LEFT JOIN e1 f ON {key_sql('a')} = f.src_key AND {key_sql('b')} = f.tgt LEFT JOIN e1 r ON {key_sql('b')} = r.src_key AND {key_sql('a')} = r.tgt"""
)
def kb_lookup_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return P.lookup(drug_pairs(spark, d), P.flatten_index(kb_edges(spark, d)))


REPORT = f"""WITH {ITEMS}, pairs AS (SELECT a.l_orderkey, a.p_name AS a, b.p_name AS b, least(a.p_type, b.p_type) || ' with ' || greatest(a.p_type, b.p_type) AS description
    FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.ord < b.ord),
graded AS (SELECT *, CASE WHEN description LIKE '%PROMO%' AND description LIKE '%ECONOMY%' THEN 3 WHEN description LIKE '%LARGE%' THEN 2 WHEN description LIKE '%SMALL%' THEN 1 ELSE 0 END AS rank FROM pairs),
per AS (SELECT l_orderkey, count(*) AS n_pairs, max(rank) AS worst, count(*) FILTER (rank >= 2) AS n_serious FROM graded GROUP BY 1),
sizes AS (SELECT l_orderkey, count(*) AS n_items FROM items GROUP BY 1)
SELECT s.l_orderkey, n_items, coalesce(n_pairs, 0) AS n_pairs, {LABEL.format("coalesce(worst, 0)")} AS max_severity, coalesce(n_serious, 0) AS n_serious,
    coalesce(n_serious, 0) > 0 AS has_safety_concerns FROM sizes s LEFT JOIN per USING (l_orderkey)"""


@query(REPORT)
def rx_interaction_report(spark: SparkSession, d: str) -> DataFrame:
    """Items of every order, their pairs graded by a rule on both types, rolled up per order."""
    items = order_items(spark, d)
    typed = items.withColumn("item", F.struct("p_name", "p_type"))
    pairs = P.enumerate_pairs(typed, "l_orderkey", "item", "ord")
    text = F.concat(F.least("first.p_type", "second.p_type"), F.lit(" with "), F.greatest("first.p_type", "second.p_type"))
    rank = F.when(text.contains("PROMO") & text.contains("ECONOMY"), 3).when(text.contains("LARGE"), 2).when(text.contains("SMALL"), 1).otherwise(0)
    per = pairs.select("l_orderkey", rank.alias("rank")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("rank").alias("worst"), F.count_if(F.col("rank") >= 2).alias("n_serious"))
    sizes = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.join(per, "l_orderkey", "left").select(
        "l_orderkey", "n_items", zero("n_pairs").alias("n_pairs"), S.label_of_rank(zero("worst")).alias("max_severity"), zero("n_serious").alias("n_serious"), (zero("n_serious") > 0).alias("has_safety_concerns")
    )


def found_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Predicted pairs: what the knowledge base has for the drugs as entered, graded by keywords."""
    found = P.lookup(drug_pairs(spark, d), P.flatten_index(kb_edges(spark, d))).where("direction is not null")
    return found.select("prescription_id", "a", "b", S.keyword_severity(F.col("description")).alias("severity"), F.struct("first_ord", "second_ord").alias("ord"))


def true_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rx_pairs(spark, d).select("prescription_id", F.col("drug_a").alias("a"), F.col("drug_b").alias("b"), S.normalize(F.col("ground_truth_severity")).alias("severity"), F.col("pos").alias("ord"))


def keyword_sql(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    tests = lambda words: " OR ".join(f"contains({low}, '{w}')" for w in words)
    return f"CASE WHEN {tests(S.SEVERE_WORDS)} THEN 'Severe' WHEN {tests(S.MODERATE_WORDS)} THEN 'Moderate' WHEN {tests(S.MILD_WORDS)} THEN 'Mild' ELSE 'Moderate' END"


MATCH = f"""{KB}, {DRUG_PAIRS}, {EDGE1}, found AS (
    SELECT prescription_id, {key_sql('a')} AS x, {key_sql('b')} AS y, {keyword_sql("coalesce(f.e, r.e).d")} AS severity, (first_ord, second_ord) AS ord
    FROM dp LEFT JOIN e1 f ON {key_sql('a')} = f.src_key AND {key_sql('b')} = f.tgt LEFT JOIN e1 r ON {key_sql('b')} = r.src_key AND {key_sql('a')} = r.tgt WHERE coalesce(f.e, r.e) IS NOT NULL),
fd AS (SELECT prescription_id, least(x, y) AS lo, greatest(x, y) AS hi, arg_min(severity, ord) AS found_severity FROM found GROUP BY ALL),
td AS (SELECT prescription_id, least({key_sql('drug_a')}, {key_sql('drug_b')}) AS lo, greatest({key_sql('drug_a')}, {key_sql('drug_b')}) AS hi,
    arg_min(coalesce(ground_truth_severity, 'No Interaction'), pos) AS true_severity FROM pr GROUP BY ALL),
matched AS (SELECT prescription_id, lo, hi, true_severity, found_severity, CASE WHEN true_severity IS NULL THEN 'fp' WHEN found_severity IS NULL THEN 'fn' ELSE 'tp' END AS outcome,
    CASE WHEN true_severity IS NOT NULL AND found_severity IS NOT NULL THEN true_severity = found_severity END AS severity_agrees
    FROM td FULL JOIN fd USING (prescription_id, lo, hi))"""


@query(f"WITH {MATCH} SELECT * FROM matched")
def pair_match_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return P.match_pairs(true_pairs(spark, d), found_pairs(spark, d), "prescription_id")


@query(
    f"""WITH {MATCH}, c AS (SELECT count(*) FILTER (outcome = 'tp')::DOUBLE AS tp, count(*) FILTER (outcome = 'fp')::DOUBLE AS fp, count(*) FILTER (outcome = 'fn')::DOUBLE AS fn,
    count(*) FILTER (severity_agrees)::DOUBLE AS same FROM matched)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(same / tp, 6) AS severity_exact FROM c"""
)
def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    matched = P.match_pairs(true_pairs(spark, d), found_pairs(spark, d), "prescription_id")
    agg = matched.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")), F.count_if(F.col("severity_agrees")).alias("same"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return agg.select("tp", "fp", "fn", r6(M.ratio(tp, tp + fp)).alias("precision"), r6(M.ratio(tp, tp + fn)).alias("recall"), r6(M.ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), r6(M.ratio(F.col("same"), tp)).alias("severity_exact"))


@query(
    f"""WITH {PR}, per AS (SELECT prescription_id, max({RANK.format("ground_truth_severity")}) AS worst, bool_or(coalesce(ground_truth_severity, '') = 'Severe') AS severe, count(*) AS n FROM pr GROUP BY 1)
SELECT r.prescription_id, coalesce(n, 0) AS interactions, {LABEL.format("coalesce(worst, 0)")} AS max_severity, coalesce(severe, false) AS has_safety_concerns,
    CASE WHEN len(r.drugs) > 0 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM rx r LEFT JOIN per USING (prescription_id)"""
)
def service_analyze(spark: SparkSession, d: str) -> DataFrame:
    """The service's answer per prescription: a concern is any Severe pair."""
    per = rx_pairs(spark, d).groupBy("prescription_id").agg(F.count(F.lit(1)).alias("n"), S.max_label(F.col("ground_truth_severity")).alias("worst"), F.bool_or(F.coalesce(F.col("ground_truth_severity") == "Severe", F.lit(False))).alias("severe"))
    return rx(spark, d).select("prescription_id", "drugs").join(per, "prescription_id", "left").select(
        "prescription_id", F.coalesce("n", F.lit(0)).alias("interactions"), F.coalesce("worst", F.lit(S.NO_INTERACTION)).alias("max_severity"), F.coalesce("severe", F.lit(False)).alias("has_safety_concerns"),
        F.when(F.coalesce(F.size("drugs"), F.lit(0)) > 0, 0.9).otherwise(0.8).alias("confidence"),
    )


@query(
    f"""WITH {PR}, p AS (SELECT prescription_id, count(*) AS n, avg((50 + text_id % 50) / 100.0::DOUBLE) AS pair_conf FROM pr GROUP BY 1),
e AS (SELECT prescription_id, count(*) AS n_entities, avg((60 + len(drug) % 40) / 100.0::DOUBLE) AS c, count(*) FILTER ((60 + len(drug) % 40) / 100.0::DOUBLE < 0.7) AS low
    FROM (SELECT prescription_id, unnest(drugs) AS drug FROM rx) WHERE drug IS NOT NULL GROUP BY 1)
SELECT r.prescription_id, coalesce(n_entities, 0) AS total_medicines, coalesce(n, 0) AS total_interactions, coalesce(n, 0) > 0 AS has_concern, coalesce(low, 0) AS low_confidence,
    round((coalesce(c, 0) + coalesce(pair_conf, 1.0)) / 2, 6) AS overall_confidence, (coalesce(c, 0) + coalesce(pair_conf, 1.0)) / 2 < 0.7 OR coalesce(low, 0) > 0 AS needs_review
FROM rx r LEFT JOIN p USING (prescription_id) LEFT JOIN e USING (prescription_id)"""
)
def output_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Counts, confidence and review flag per prescription; a concern is any pair."""
    base = rx(spark, d).select("prescription_id", "drugs")
    pairs = rx_pairs(spark, d).groupBy("prescription_id").agg(F.count(F.lit(1)).alias("n"), F.avg((50 + F.col("text_id") % 50) / F.lit(100.0)).alias("pair_conf"))
    conf = (60 + F.length("drug") % 40) / F.lit(100.0)
    entities = base.select("prescription_id", F.explode("drugs").alias("drug")).where("drug is not null").groupBy("prescription_id").agg(F.count(F.lit(1)).alias("n_entities"), F.avg(conf).alias("c"), F.count_if(conf < 0.7).alias("low"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    overall = (zero("c") + F.coalesce("pair_conf", F.lit(1.0))) / 2
    joined = base.select("prescription_id").join(pairs, "prescription_id", "left").join(entities, "prescription_id", "left")
    return joined.select(
        "prescription_id", zero("n_entities").alias("total_medicines"), zero("n").alias("total_interactions"), (zero("n") > 0).alias("has_concern"), zero("low").alias("low_confidence"),
        r6(overall).alias("overall_confidence"), ((overall < 0.7) | (zero("low") > 0)).alias("needs_review"),
    )


@query(
    """WITH own AS (SELECT DISTINCT split_name, text FROM conflicts WHERE trim(text) <> '' AND split_name IS NOT NULL)
SELECT t.split_name, o.split_name AS other_split, count(*) AS texts, count(*) FILTER (EXISTS (SELECT 1 FROM own x WHERE x.split_name = o.split_name AND x.text = t.text)) AS verbatim
FROM own t, (SELECT DISTINCT split_name FROM own) o WHERE t.split_name <> o.split_name GROUP BY 1, 2"""
)
def decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each split, and how many of them occur verbatim in each other split."""
    own = table(spark, d, "conflicts").where("trim(text) != '' and split_name is not null").select("split_name", "text").distinct()
    per_text = own.groupBy("text").agg(F.collect_set("split_name").alias("splits"))
    splits = own.select(F.col("split_name").alias("other_split")).distinct()
    rows = per_text.select("splits", F.explode("splits").alias("split_name")).crossJoin(F.broadcast(splits)).where("split_name != other_split")
    return rows.groupBy("split_name", "other_split").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.array_contains("splits", F.col("other_split"))).alias("verbatim"))


@query(
    f"""WITH {RX}, {EV}, it AS (SELECT prescription_id, unnest(drugs) AS drug FROM rx)
SELECT e.prescription_id, e.run_name, d.drug, contains(lower(e.prescription_text), lower(d.drug)) OR contains(lower(d.drug), lower(e.prescription_text)) AS found
FROM (SELECT DISTINCT prescription_id, run_name, prescription_text FROM ev) e JOIN (SELECT DISTINCT prescription_id, drug FROM it WHERE {strip_sql('drug')} <> '') d USING (prescription_id)"""
)
def gt_drug_found(spark: SparkSession, d: str) -> DataFrame:
    """Whether each drug of a prescription is contained in the text that a run saw, or the other way round."""
    drugs = rx(spark, d).select("prescription_id", F.explode("drugs").alias("drug")).where(stripped(F.col("drug")) != "").distinct()
    runs = evals(spark, d).select("prescription_id", "run_name", "prescription_text").distinct()
    text, drug = F.lower("prescription_text"), F.lower("drug")
    return runs.join(drugs, "prescription_id").select("prescription_id", "run_name", "drug", (text.contains(drug) | drug.contains(text)).alias("found"))


@query(
    f"""WITH {RX}, it AS (SELECT prescription_id, {key_sql('drug')} AS name, ord FROM (SELECT prescription_id, unnest(drugs) AS drug, unnest(range(len(drugs))) AS ord FROM rx) WHERE {strip_sql('drug')} <> '')
SELECT prescription_id, name, min(ord)::INT AS ord, count(*) AS times FROM it GROUP BY 1, 2"""
)
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of a prescription at their first place."""
    items = rx(spark, d).select("prescription_id", F.posexplode("drugs").alias("ord", "drug")).where(stripped(F.col("drug")) != "")
    return items.groupBy("prescription_id", name_key(F.col("drug")).alias("name")).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("times"))
