"""Scans, coercions, hashes, reports and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity as S
from ..plans.session import ensure_checkpoint_dir
from ..sources import readers as R
from ..sources.tables import table
from .registry import EV, PR, RX, evals, query, r6, rx, rx_pairs

RAGGED = "rg AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || chr(9) || c_mktsegment WHEN 2 THEN c_name || chr(9) || c_mktsegment || chr(9) || c_nationkey ELSE c_name || chr(9) || c_mktsegment || chr(9) || c_nationkey || chr(9) || 'extra' || chr(9) END AS line FROM customer)"


@query(f"WITH {RAGGED} SELECT split_part(line, chr(9), 1) AS name, split_part(line, chr(9), 2) AS segment, split_part(line, chr(9), 3) AS nation FROM rg WHERE len(string_split(line, chr(9))) >= 3")
def ragged_tsv(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    kind, tab = F.col("c_custkey") % 4, F.lit("\t")
    two = F.concat("c_name", tab, "c_mktsegment")
    three = F.concat(two, tab, F.col("c_nationkey").cast("string"))
    line = F.when(kind == 0, F.col("c_name")).when(kind == 1, two).when(kind == 2, three).otherwise(F.concat(three, tab, F.lit("extra"), tab))
    return R.ragged(c.select(line.alias("line")), "line", ["name", "segment", "nation"])


@query("SELECT drug_name AS name, drug_class AS class, array_to_string(coalesce(brand_names, []), ';') AS brands FROM drug_reference WHERE drug_name IS NOT NULL")
def csv_token_scan(spark: SparkSession, d: str) -> DataFrame:
    """The drug list written as CSV and read back, rows without a name dropped."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    ref = table(spark, d, "drug_reference").select(F.col("drug_name").alias("name"), F.col("drug_class").alias("class"), F.array_join(F.coalesce("brand_names", F.array().cast("array<string>")), ";").alias("brands"))
    ref.write.csv(path, header=True, escape='"', emptyValue="")
    rows = R.read_csv(spark, path, "name")
    return rows.select("name", "class", F.coalesce("brands", F.lit("")).alias("brands"))


@query(f"WITH {EV} SELECT prescription_id, run_name, pred_severity, count(*) AS n FROM ev GROUP BY ALL")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows appended as JSON lines and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jsonl-{uuid.uuid4().hex}"
    rows = evals(spark, d).select("prescription_id", "run_name", "pred_severity")
    rows.write.json(path)
    return R.read_jsonl(spark, path, "prescription_id int, run_name string, pred_severity string").groupBy("prescription_id", "run_name", "pred_severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH h AS (SELECT sha256(drug_id::VARCHAR || chr(31) || drug_name) AS h FROM drug_reference), s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::HUGEINT) AS a, sum(('0x' || substr(h, 13, 12))::HUGEINT) AS b FROM h)
SELECT substr(sha256(n || '|' || a || '|' || b), 1, 16) AS digest FROM s"""
)
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return R.content_hash(table(spark, d, "drug_reference"), ["drug_id", "drug_name"])


@query("SELECT drug_id, CASE WHEN drug_id % 3 = 0 THEN [drug_name] WHEN drug_id % 3 = 1 THEN coalesce(brand_names, []) ELSE [] END AS names FROM drug_reference")
def variant_coerce(spark: SparkSession, d: str) -> DataFrame:
    """A field that is a string, a list or an object, read as a list."""
    ref = table(spark, d, "drug_reference")
    text = F.to_json(F.struct(F.col("drug_name").alias("x")))
    listed = F.to_json(F.struct(F.coalesce("brand_names", F.array().cast("array<string>")).alias("x")))
    raw = F.when(F.col("drug_id") % 3 == 0, text).when(F.col("drug_id") % 3 == 1, listed).otherwise('{"x": {"deep": 1}}')
    return ref.select("drug_id", R.strings(F.parse_json(raw), "$.x").alias("names"))


@query(
    f"""WITH {EV}, m AS (SELECT run_name, count(*) AS n, avg((gt_severity = pred_severity)::INT) AS acc, count(*) FILTER (gt_severity = 'Severe' AND pred_severity <> 'Severe') AS missed FROM ev GROUP BY 1)
SELECT run_name, 'Run ' || run_name || ': ' || n || ' rows, accuracy ' || printf('%.4f', acc) || ', missed severe ' || missed || CASE WHEN acc >= 0.7 THEN ' [OK]' ELSE ' [WARN]' END AS report FROM m"""
)
def text_report(spark: SparkSession, d: str) -> DataFrame:
    m = evals(spark, d).groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gt_severity") == F.col("pred_severity")).cast("int")).alias("acc"), F.count_if((F.col("gt_severity") == "Severe") & (F.col("pred_severity") != "Severe")).alias("missed"))
    line = F.format_string("Run %s: %d rows, accuracy %.4f, missed severe %d%s", "run_name", "n", "acc", "missed", F.when(F.col("acc") >= 0.7, " [OK]").otherwise(" [WARN]"))
    return m.select("run_name", line.alias("report"))


@query(
    f"""WITH {PR}, c AS (SELECT count(*) FILTER (NOT coalesce(ground_truth_severity IN ('Mild', 'Moderate', 'Severe'), false)) AS a, count(*) FILTER (NOT coalesce(trim(drugbank_description) <> '', false)) AS b, count(*) FILTER (NOT coalesce(drug_a <> drug_b, false)) AS c, count(*) FILTER (drugbank_id IS NULL) AS d FROM pr)
SELECT unnest(['label_domain', 'text_present', 'two_drugs', 'id_present']) AS rule, unnest([a, b, c, d]) AS violations FROM c"""
)
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "label_domain": F.col("ground_truth_severity").isin(*S.LABELS),
        "text_present": F.trim("drugbank_description") != "",
        "two_drugs": F.col("drug_a") != F.col("drug_b"),
        "id_present": F.col("drugbank_id").isNotNull(),
    }
    return R.violations(rx_pairs(spark, d), rules)


@query(f"WITH {EV} SELECT run_name, count(*) FILTER (latency_seconds < 0.7) AS low, count(*) FILTER (latency_seconds >= 0.7) AS ok, count(*) FILTER (latency_seconds IS NULL) AS unknown FROM ev GROUP BY run_name")
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Values under 0.7, at or above it, and missing ones."""
    v = F.col("latency_seconds")
    return evals(spark, d).groupBy("run_name").agg(F.count_if(v < 0.7).alias("low"), F.count_if(v >= 0.7).alias("ok"), F.count_if(v.isNull()).alias("unknown"))


@query(f"WITH {RX}, t AS (SELECT prescription_id, unnest(drugs) AS text FROM rx) SELECT prescription_id, text, round((50 + len(text) % 50) / 100.0::DOUBLE, 6) AS score FROM t WHERE trim(text) <> '' AND (50 + len(text) % 50) / 100.0::DOUBLE >= 0.6")
def ner_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Spans whose score reaches the threshold, empty ones dropped; the score stands in for a model's."""
    t = rx(spark, d).select("prescription_id", F.explode("drugs").alias("text")).where(F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "") != "")
    score = (50 + F.length("text") % 50) / F.lit(100.0)
    return t.where(score >= 0.6).select("prescription_id", "text", r6(score).alias("score"))
