"""The whole flow over the prescriptions, its evaluation, and the encoder stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity as S
from ..functions import vectors as V
from ..operators import matching as X
from ..operators import metrics as M
from ..operators import pairs as P
from ..plans import pipeline as L
from ..sources.tables import table
from .lexicon import aliases, generics
from .pairs import kb_edges
from .registry import EV, evals, query, r6, rx
from .severity import RISK_SQL


def knowledge(spark: SparkSession, d: str) -> L.Knowledge:
    synonyms = aliases(spark, d).groupBy("alias").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    return L.Knowledge(generics(spark, d).select("name"), synonyms, P.flatten_index(kb_edges(spark, d)))


def reports(spark: SparkSession, d: str) -> DataFrame:
    texts = rx(spark, d).select(F.col("prescription_id").alias("rx_id"), F.col("prescription_text").alias("text"))
    return L.analyze(texts, knowledge(spark, d))


@query()
def pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    """One report per prescription, from its text alone."""
    return reports(spark, d)


@query()
def pipeline_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The reports against the recorded severities: accuracy, macro F1 and the sensitivity for serious cases."""
    truth = rx(spark, d).select(F.col("prescription_id").alias("rx_id"), F.explode_outer("interactions").alias("x")).groupBy("rx_id").agg(S.max_label(F.col("x.ground_truth_severity")).alias("truth"))
    rows = reports(spark, d).select("rx_id", F.col("max_severity").alias("found")).join(truth, "rx_id")
    s = M.summary(rows, "truth", "found", S.OUTCOMES).select("n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))
    b = M.binary(rows, S.rank(F.col("truth")) >= 2, S.rank(F.col("found")) >= 2).select(r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))
    return s.crossJoin(b)


@query(
    f"""WITH {EV}, m AS (SELECT run_name, count(*) AS n, round(avg((gt_severity = pred_severity)::INT), 6) AS accuracy, round(avg({RISK_SQL.format("pred_severity")}), 6) AS mean_risk, round(avg(latency_seconds), 6) AS mean_latency, sum(gemini_errors)::BIGINT AS errors FROM ev GROUP BY 1)
SELECT run_name, n, accuracy, mean_risk, mean_latency, errors FROM m"""
)
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    """One line of figures per run."""
    right = (F.col("gt_severity") == F.col("pred_severity")).cast("int")
    return evals(spark, d).groupBy("run_name").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(right)).alias("accuracy"), r6(F.avg(S.risk_score(F.col("pred_severity")))).alias("mean_risk"), r6(F.avg("latency_seconds")).alias("mean_latency"), F.sum("gemini_errors").alias("errors")
    )


@query()
def hash_encode_search(spark: SparkSession, d: str) -> DataFrame:
    """Brand names against drug names by hashed 3-gram vectors; queries are the drugs whose id is divisible by 20."""
    ref = table(spark, d, "drug_reference")
    corpus = ref.select(F.col("drug_id").alias("id"), V.hashed_trigrams(F.col("drug_name")).alias("vec"))
    asked = ref.where("drug_id % 20 = 0").select(F.col("drug_id").alias("q"), V.hashed_trigrams(F.lower("drug_name")).alias("vec"))
    return X.top_cosine(asked, corpus, 3).select("q", "id", r6("score").alias("score"), "rank")
