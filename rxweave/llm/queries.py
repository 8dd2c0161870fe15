"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import canonical, consensus, cooccurrence, leakage, near_duplicates, overlap, records, residue, tokenize


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = records.one_per_id(records.description_records(spark, sf_dir))
    pairs, members = near_duplicates.similar_pairs(texts)
    return near_duplicates.expand_pairs(pairs, members)


def _split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = records.one_per_id(records.description_records(spark, sf_dir))
    return overlap.expand(*overlap.cross_split(texts))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _split_overlaps(spark, sf_dir)
    return pairs.select(F.least("train_id", "eval_id").alias("text_id_a"), F.greatest("train_id", "eval_id").alias("text_id_b"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and the tables of both records."""
    source = records.one_per_id(records.description_records(spark, sf_dir)).select("text_id", "source")
    return (
        _split_overlaps(spark, sf_dir)
        .join(source.select(F.col("text_id").alias("eval_id"), F.col("source").alias("eval_source")), "eval_id")
        .join(source.select(F.col("text_id").alias("train_id"), F.col("source").alias("train_source")), "train_id")
        .groupBy("eval_split", "eval_source", "train_source")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_distinct("eval_id").alias("eval_records"),
            F.count_distinct("train_id").alias("train_records"),
            F.count_if(F.col("jaccard") == 1).alias("same_words"),
        )
    )


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item, annotator, label`` of every vote; a repeated row counts once."""
    rows = table(spark, sf_dir, "conflicts").select("id", "round_no", "agentA", "agentB", "annotator_a", "annotator_b").distinct()
    pairs = F.array(F.struct(F.col("annotator_a").alias("annotator"), F.col("agentA").alias("written")), F.struct(F.col("annotator_b").alias("annotator"), F.col("agentB").alias("written")))
    return rows.select(F.col("id").alias("item"), F.explode(pairs).alias("v")).select("item", "v.annotator", consensus.read_label(F.col("v.written")).alias("label"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus.consensus(_votes(spark, sf_dir))
    return items.select(F.col("item").alias("id"), F.col("label").alias("severity"))


def p2_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(_votes(spark, sf_dir))[1]


def p2_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dual objective after every round, what the round gained, and whether the fit had converged at the end."""
    made = consensus.fit(_votes(spark, sf_dir))
    rows = [(k + 1, x, x - made.objective[k - 1] if k else None, made.converged) for k, x in enumerate(made.objective)]
    return spark.createDataFrame(rows, "round int, objective double, gain double, converged boolean")


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = consensus.agreement(_votes(spark, sf_dir))
    return got.select("items", "votes", F.round("agreeing_share", 6).alias("agreeing_share"), F.round("alpha", 6).alias("alpha"))


def _prescribed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = table(spark, sf_dir, "keyword_smoke10").select("prescription_id", "drugs")
    return cooccurrence.basket_items(rows, "prescription_id", "drugs"), rows.select("prescription_id").distinct().count()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, baskets = _prescribed(spark, sf_dir)
    pairs = cooccurrence.associations(entries, baskets, least=max(5, -(-baskets // 200)))
    often = F.col("together") * baskets >= 3 * F.col("n_a") * F.col("n_b")
    return pairs.where(often).select(F.col("a").alias("drug_a"), F.col("b").alias("drug_b"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair in at least 5 prescriptions, with its association scores; lists of more than 4 entries go by chunk pairs."""
    entries, baskets = _prescribed(spark, sf_dir)
    pairs = cooccurrence.associations(entries, baskets, least=5, block=4)
    return pairs.select("a", "b", "together", "n_a", "n_b", *(F.round(c, 6).alias(c) for c in ("lift", "pmi", "npmi", "jaccard", "g2")))


def _drug_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``prescription_id, entered`` that are neither blank nor a drug name letter for letter."""
    own = table(spark, sf_dir, "keyword_smoke10").select("prescription_id", F.explode("drugs").alias("entered"))
    missed = table(spark, sf_dir, "detailed_results").select("prescription_id", F.col("missed_drugs").alias("written")).where("written is not null and written != '[]'")
    parsed = canonical.parse_lists(missed)
    listed = missed.distinct().join(parsed, "written").select("prescription_id", F.explode("values").alias("entered"))
    names = table(spark, sf_dir, "drug_reference").select(F.col("drug_name").alias("entered")).distinct()
    rows = own.unionByName(listed).where(cooccurrence.trimmed(F.col("entered")) != "").where("prescription_id is not null")
    return rows.join(names, "entered", "left_anti").select("prescription_id", "entered").distinct()


def _drug_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    drugs = table(spark, sf_dir, "drug_reference").select(F.col("drug_id").cast("bigint").alias("target"), "drug_name", "brand_names")
    return drugs.select("target", F.col("drug_name").alias("surface")).unionByName(drugs.select("target", F.explode("brand_names").alias("surface")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _drug_entries(spark, sf_dir)
    mapped = canonical.map_values(entries, _drug_surfaces(spark, sf_dir)).select("entered", "target")
    return entries.join(mapped, "entered").select("prescription_id", "entered", F.coalesce("target", F.lit(-1)).cast("int").alias("drug_id"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that belong to no entry of the list: how often they occur and the entry that came closest."""
    entries = _drug_entries(spark, sf_dir)
    mapped = canonical.map_values(entries, _drug_surfaces(spark, sf_dir), reported=0.2).where("target is null")
    counts = entries.groupBy("entered").agg(F.count(F.lit(1)).alias("prescriptions"))
    return counts.join(mapped, "entered").select("entered", "prescriptions", F.col("first").cast("int").alias("closest_drug_id"), F.round("score", 4).alias("score"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"), *tokenize.tokenizer_file())


def p6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, with leaves so short that most documents are put together from a tree of them."""
    made = tokenize.encode_corpus(table(spark, sf_dir, "documents"), *tokenize.tokenizer_file(), leaf_chars=128)
    return made.select("doc_id", F.size("ids").alias("tokens"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every document: kept, stripped of leaked spans, or dropped."""
    made = leakage.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))
    return made.select("doc_id", "action", F.round("coverage", 6).alias("coverage"), "spans", F.length("text").alias("chars_left"))


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents").withColumnRenamed("source", "host"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir).select("doc_id")


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded documents per source and reason."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return _residue(spark, sf_dir).join(sources, "doc_id").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_annotators, p2_rounds, p2_agreement, p3_found, p3_pairs, p4_found, p4_unmatched, p5_found, p5_counts, p6_ids, p6_lengths, p7_found, p7_clean, p8_found, p8_reasons)}


SPACES = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}\x{FEFF}]"
ENTRIES = f"""entries AS (
    SELECT DISTINCT prescription_id AS basket, lower(regexp_replace(d, '^{SPACES}+|{SPACES}+$', '', 'g')) AS item
    FROM (SELECT prescription_id, unnest(drugs) AS d FROM keyword_smoke10) WHERE d IS NOT NULL AND prescription_id IS NOT NULL
), kept AS (SELECT * FROM entries WHERE item <> ''),
total AS (SELECT count(DISTINCT prescription_id) AS n FROM keyword_smoke10),
singles AS (SELECT item, count(*) AS n FROM kept GROUP BY item),
pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS together FROM kept x JOIN kept y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)"""
P3_FOUND = f"""WITH {ENTRIES}
SELECT a AS drug_a, b AS drug_b FROM pairs JOIN singles p ON p.item = a JOIN singles q ON q.item = b, total
WHERE together >= 5 AND together * 200 >= total.n AND together * total.n >= 3 * p.n * q.n"""
P3_PAIRS = f"""WITH {ENTRIES}, t AS (
    SELECT a, b, together, p.n AS n_a, q.n AS n_b, together::DOUBLE AS n11, p.n::DOUBLE AS na, q.n::DOUBLE AS nb, total.n::DOUBLE AS n
    FROM pairs JOIN singles p ON p.item = a JOIN singles q ON q.item = b, total WHERE together >= 5)
SELECT a, b, together, n_a, n_b, round(n11 * n / (na * nb), 6) AS lift, round(ln(n11 * n / (na * nb)), 6) AS pmi,
    round(CASE WHEN n11 < n THEN ln(n11 * n / (na * nb)) / -ln(n11 / n) ELSE 1.0 END, 6) AS npmi,
    round(n11 / (na + nb - n11), 6) AS jaccard,
    round(2 * (n11 * ln(n11 / (na * nb / n))
        + CASE WHEN na - n11 > 0 THEN (na - n11) * ln((na - n11) / (na * (n - nb) / n)) ELSE 0.0 END
        + CASE WHEN nb - n11 > 0 THEN (nb - n11) * ln((nb - n11) / ((n - na) * nb / n)) ELSE 0.0 END
        + CASE WHEN n - na - nb + n11 > 0 THEN (n - na - nb + n11) * ln((n - na - nb + n11) / ((n - na) * (n - nb) / n)) ELSE 0.0 END), 6) AS g2
FROM t"""


P2_AGREEMENT = """WITH rounds AS (SELECT DISTINCT id, round_no, agentA, agentB, annotator_a, annotator_b FROM conflicts WHERE id IS NOT NULL),
spelt AS (SELECT id, lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS w FROM (SELECT id, agentA AS w FROM rounds UNION ALL SELECT id, agentB FROM rounds)),
votes AS (SELECT id, CASE WHEN w LIKE 'mi%' OR w = 'mld' THEN 'Mild' WHEN w LIKE 'mo%' THEN 'Moderate' WHEN w LIKE 'se%' THEN 'Severe' END AS label FROM spelt),
per AS (SELECT id, label, count(*)::DOUBLE AS n FROM votes WHERE label IS NOT NULL GROUP BY 1, 2),
items AS (SELECT id, sum(n) AS m, sum(n * (n - 1)) AS same FROM per GROUP BY id HAVING sum(n) >= 2),
seen AS (SELECT count(*) AS items, sum(m) AS total, sum(same / (m - 1)) AS o FROM items),
shares AS (SELECT label, sum(n) AS n FROM per WHERE id IN (SELECT id FROM items) GROUP BY label),
chance AS (SELECT sum(n * (n - 1)) AS e FROM shares)
SELECT items, total::BIGINT AS votes, round(o / total, 6) AS agreeing_share, round((o / total - e / (total * (total - 1))) / (1 - e / (total * (total - 1))), 6) AS alpha FROM seen, chance"""


# every pair by brute force, over the words they have in common
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
RECORDS = f"""records AS (
    SELECT 'conflicts' AS source, id AS text_id, max(text) AS text, max(split_name) AS split FROM conflicts WHERE id IS NOT NULL GROUP BY id
    UNION ALL SELECT 'keyword_smoke10', x.text_id, max(x.drugbank_description), max(split_name) FROM (SELECT unnest(interactions) AS x, split_name FROM keyword_smoke10) WHERE x.text_id IS NOT NULL GROUP BY x.text_id
), sets AS (SELECT source, text_id, split, list_distinct({WORDS}) AS ws FROM records),
w AS (SELECT source, text_id, split, len(ws) AS n, unnest(ws) AS w FROM sets)"""
SHARED = "count(*) * 1.0 / (any_value(a.n) + any_value(b.n) - count(*))"
P1_FOUND = f"""WITH {RECORDS}
SELECT a.text_id AS text_id_a, b.text_id AS text_id_b FROM w a JOIN w b ON a.w = b.w AND a.source = b.source AND a.text_id < b.text_id
GROUP BY a.source, a.text_id, b.text_id HAVING 10 * count(*) >= 6 * (any_value(a.n) + any_value(b.n) - count(*))"""
OVERLAPS = f"""{RECORDS}, found AS (
    SELECT a.source AS train_source, a.text_id AS train_id, b.source AS eval_source, b.text_id AS eval_id, b.split AS eval_split, {SHARED} AS jaccard
    FROM w a JOIN w b ON a.w = b.w AND a.split = 'train' AND b.split IN ('val', 'test')
    GROUP BY ALL HAVING 10 * count(*) >= 6 * (any_value(a.n) + any_value(b.n) - count(*)))"""
P5_FOUND = f"WITH {OVERLAPS} SELECT least(train_id, eval_id) AS text_id_a, greatest(train_id, eval_id) AS text_id_b FROM found"
P5_COUNTS = f"""WITH {OVERLAPS} SELECT eval_split, eval_source, train_source, count(*) AS pairs, count(DISTINCT eval_id) AS eval_records,
    count(DISTINCT train_id) AS train_records, count(*) FILTER (jaccard = 1) AS same_words FROM found GROUP BY 1, 2, 3"""
# every run of ten words on either side
RUNS = "SELECT DISTINCT {key}, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {key}, {words} AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL))"
P7_FOUND = f"""WITH d AS ({RUNS.format(key="doc_id", words=WORDS, table="documents")}), t AS ({RUNS.format(key="item_id", words=WORDS, table="test_items")})
SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (run)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p5_found": P5_FOUND, "p5_counts": P5_COUNTS, "p7_found": P7_FOUND, "p2_agreement": P2_AGREEMENT, "p3_found": P3_FOUND, "p3_pairs": P3_PAIRS}
