"""Trial-log analytics, folds, splits, chunks, usage roll-ups, parameter spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as Q
from ..plans.session import literal_rows
from ..sources.tables import table
from .registry import EV, evals, query, r6
from .severity import gate_scores, FEATURES_SQL, TRUTH

# A trial log made of parts: two hyper-parameters, a score, fold scores, parameters and a configuration.
TR = """tr AS (SELECT 't' || p_partkey AS trial, p_size % 5 AS layers, p_partkey % 4 AS width, (p_retailprice - 900) / 1000 + (p_size % 7) / 10.0::DOUBLE AS f1, list_transform(range(5), lambda i: (p_retailprice - 900) / 1000 + ((p_size + i) % 7) / 10.0::DOUBLE) AS folds,
    1000 * (p_size + 1) AS params, CASE WHEN p_partkey % 2 = 0 THEN 'screen' ELSE 'refine' END AS kind, pow(10.0::DOUBLE, -(1 + p_size % 5)) AS rate FROM part)"""


def trials(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    price = (F.col("p_retailprice") - 900) / 1000
    return part.select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("trial"), (F.col("p_size") % 5).alias("layers"), (F.col("p_partkey") % 4).alias("width"), (price + (F.col("p_size") % 7) / 10).alias("f1"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: price + ((F.col("p_size") + i) % 7) / 10).alias("folds"), (1000 * (F.col("p_size") + 1)).alias("params"),
        F.when(F.col("p_partkey") % 2 == 0, "screen").otherwise("refine").alias("kind"), F.pow(F.lit(10.0), -(1 + F.col("p_size") % 5)).alias("rate"),
    )


@query(f"WITH {TR} SELECT layers, {', '.join(f'round(avg(f1) FILTER (width = {w}), 6) AS mean_{w}, count(*) FILTER (width = {w}) AS n_{w}' for w in range(4))} FROM tr GROUP BY layers")
def trial_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = trials(spark, d).groupBy("layers").pivot("width", [0, 1, 2, 3]).agg(F.avg("f1").alias("mean"), F.count(F.lit(1)).alias("n"))
    return wide.select("layers", *(c for w in range(4) for c in (r6(f"{w}_mean").alias(f"mean_{w}"), F.coalesce(f"{w}_n", F.lit(0)).alias(f"n_{w}"))))


COLS = ("layers", "width", "f1", "params")


@query(f"WITH {TR}, rk AS (SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}' for c in COLS)} FROM tr) {' UNION ALL '.join(f'SELECT {chr(39)}{a}{chr(39)} AS a, {chr(39)}{b}{chr(39)} AS b, round(corr({a}, {b}), 6) AS r FROM rk' for a in COLS for b in COLS)}")
def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    return Q.spearman(trials(spark, d), list(COLS)).select("a", "b", r6("r").alias("r"))


@query(f"WITH {TR}, f AS (SELECT trial, unnest(folds) AS v FROM tr) SELECT trial, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(stddev_pop(v), 6) AS std0 FROM f GROUP BY trial")
def fold_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = trials(spark, d).select("trial", F.explode("folds").alias("v"))
    return rows.groupBy("trial").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("std"), r6(F.stddev_pop("v")).alias("std0"))


@query(f"WITH {TR} SELECT trial, round(f1, 6) AS f1, params FROM tr WHERE f1 >= (SELECT max(f1) FROM tr) - 0.1 ORDER BY params, f1 DESC, trial LIMIT 1")
def winner_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return Q.winner(trials(spark, d), "f1", "params", 0.1).select("trial", r6("f1").alias("f1"), "params")


@query(f"WITH {TR} SELECT kind, round(max(f1), 6) AS best, round(avg(f1), 6) AS mean, count(*) FILTER (f1 > 0.5) AS beating FROM tr GROUP BY kind")
def screen_summary(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).groupBy("kind").agg(r6(F.max("f1")).alias("best"), r6(F.avg("f1")).alias("mean"), F.count_if(F.col("f1") > 0.5).alias("beating"))


@query(f"WITH {TR} SELECT trial, kind, layers, NULL::INT AS folds FROM tr WHERE kind = 'screen' UNION ALL SELECT trial, kind, NULL, len(folds)::INT FROM tr WHERE kind = 'refine'")
def trial_union(spark: SparkSession, d: str) -> DataFrame:
    """Two logs with different columns as one."""
    t = trials(spark, d)
    screen = t.where("kind = 'screen'").select("trial", "kind", "layers")
    refine = t.where("kind = 'refine'").select("trial", "kind", F.size("folds").alias("folds"))
    return screen.unionByName(refine, allowMissingColumns=True).select("trial", "kind", "layers", "folds")


@query(f"WITH {TR}, cf AS (SELECT DISTINCT substr(trial, -2) AS short FROM tr WHERE len(trial) = 3) SELECT trial, short FROM tr JOIN cf ON ends_with(trial, short)")
def config_lookup_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Trials joined to the configuration whose two-sign name ends theirs: an equi-join on the suffix."""
    t = trials(spark, d)
    configs = t.where(F.length("trial") == 3).select(F.substr("trial", F.lit(-2)).alias("short")).distinct()
    return t.select("trial", F.substr("trial", F.lit(-2)).alias("short")).join(configs, "short")


@query(f"WITH {TR} SELECT trial, round(log10(rate), 6) AS log_rate, round(log10(params), 6) AS log_params FROM tr")
def log_params(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).select("trial", r6(F.log10("rate")).alias("log_rate"), r6(F.log10("params")).alias("log_params"))


@query(f"WITH {TR} SELECT trial, k AS param, v AS value FROM (SELECT trial, 'layers' AS k, layers::VARCHAR AS v FROM tr UNION ALL SELECT trial, 'width', width::VARCHAR FROM tr UNION ALL SELECT trial, 'kernels', (layers + 1) || '-' || (layers + 2) FROM tr)")
def config_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested configurations as rows; a list becomes its values joined by hyphens."""
    t = trials(spark, d).select("trial", F.to_json(F.struct("layers", "width", F.array(F.col("layers") + 1, F.col("layers") + 2).alias("kernels"))).alias("config"))
    parsed = t.select("trial", F.explode(F.from_json("config", "map<string,string>")).alias("param", "v"))
    listed = F.array_join(F.from_json("v", "array<string>"), "-")
    return parsed.select("trial", "param", F.when(F.col("v").startswith("["), listed).otherwise(F.col("v")).alias("value"))


H = "('0x' || substr(md5('{0}|' || {1}), 1, 15))::BIGINT"


@query(f"WITH h AS (SELECT o_orderkey, o_orderpriority, {H.format(5, 'o_orderkey')} AS h FROM orders) SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) - 1) % 5)::INT AS fold FROM h")
def kfold_stratified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return Q.folds(rows, "o_orderkey", "o_orderpriority", 5, 5).select("o_orderkey", "fold")


@query(f"WITH h AS (SELECT o_orderkey, {H.format(9, 'o_orderkey')} AS h FROM orders) SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h) <= floor((SELECT count(*) FROM orders) * 0.8) THEN 'train' ELSE 'val' END AS part FROM h")
def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    return Q.seeded_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 9)


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (SELECT count(*) FROM orders) // 40 AS size FROM orders) SELECT o_orderkey, least(i // size, 39)::INT AS chunk FROM n")
def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    return Q.chunked(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 40)


@query("WITH c AS (SELECT id, chunk, round_no, agentA, labelled_at FROM conflicts WHERE agentA IS NOT NULL) SELECT id, arg_max(agentA, (chunk, round_no, labelled_at, agentA)) AS label, max(chunk) AS chunk FROM c GROUP BY id")
def label_merge(spark: SparkSession, d: str) -> DataFrame:
    """Labels from several chunk files: the last chunk, then the last round, wins per item."""
    rows = table(spark, d, "conflicts").where("agentA is not null")
    return rows.groupBy("id").agg(F.max_by("agentA", F.struct("chunk", "round_no", "labelled_at", "agentA")).alias("label"), F.max("chunk").alias("chunk"))


@query(f"WITH {EV}, rx AS (SELECT DISTINCT prescription_id FROM keyword_smoke10), runs AS (SELECT DISTINCT run_name FROM ev) SELECT prescription_id, run_name FROM rx, runs WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.prescription_id = rx.prescription_id AND ev.run_name = runs.run_name AND coalesce(gemini_errors, 0) = 0)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed evaluation has left: missing rows and rows with errors."""
    done = evals(spark, d).select("prescription_id", "run_name", F.col("gemini_errors").alias("errors"))
    work = table(spark, d, "keyword_smoke10").select("prescription_id").distinct().crossJoin(F.broadcast(done.select("run_name").distinct()))
    return Q.pending(work, done, ["prescription_id", "run_name"])


@query("WITH s AS (SELECT a.d AS d_model, b.h AS nhead, c.l AS layers FROM (VALUES (32), (48), (64), (96)) a(d), (VALUES (2), (3), (4), (8)) b(h), (VALUES (1), (2), (3)) c(l) WHERE a.d % b.h = 0) SELECT d_model, nhead, layers FROM s ORDER BY md5('7|' || d_model || '|' || nhead || '|' || layers) LIMIT 10")
def param_space_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten configurations of a parameter space, in hashed order, where the heads divide the width."""
    space = literal_rows(spark, d_model=[32, 48, 64, 96]).crossJoin(literal_rows(spark, nhead=[2, 3, 4, 8])).crossJoin(literal_rows(spark, layers=[1, 2, 3]))
    return space.where("d_model % nhead = 0").orderBy(F.md5(F.concat_ws("|", F.lit("7"), "d_model", "nhead", "layers"))).limit(10)


@query("SELECT p_size AS configured, list_filter(list_transform(range(0, 12), lambda k: (p_size * 64) >> k), lambda x: x >= 16) AS attempts FROM (SELECT DISTINCT p_size FROM part)")
def halving_sequence(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select("p_size").distinct()
    steps = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.floor(F.col("p_size") * 64 / F.pow(F.lit(2), k)).cast("int"))
    return sizes.select(F.col("p_size").alias("configured"), F.filter(steps, lambda x: x >= 16).alias("attempts"))


@query("SELECT l_linenumber AS attempt, least(30.0, 2.0 * pow(2, l_linenumber))::DOUBLE AS wait, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    wait = F.least(F.lit(30.0), 2.0 * F.pow(F.lit(2), F.col("l_linenumber")))
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("attempt"), wait.alias("wait")).agg(F.count(F.lit(1)).alias("n"))


CALLS = "cl AS (SELECT event_type AS context, event_id % 10 = 0 AS error, event_id % 500 AS ti, user_id % 200 AS t_out, event_id % 70 AS tt, value / 100 AS lat FROM events)"


@query(
    f"""WITH {CALLS}, g AS (SELECT coalesce(context, 'total') AS context, count(*) FILTER (NOT error) AS calls, count(*) FILTER (error) AS errors, (sum(ti) FILTER (NOT error))::BIGINT AS input_tokens, (sum(t_out) FILTER (NOT error))::BIGINT AS output_tokens,
    (sum(tt) FILTER (NOT error))::BIGINT AS thinking_tokens, sum(lat) FILTER (NOT error) AS latency FROM cl GROUP BY ROLLUP (context))
SELECT context, calls, errors, input_tokens, output_tokens, thinking_tokens, round(latency, 4) AS latency, round(latency / calls, 6) AS avg_latency, round(input_tokens / 1e6 * 0.3 + (output_tokens + thinking_tokens) / 1e6 * 2.5, 6) AS cost FROM g"""
)
def usage_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    calls = e.select(F.col("event_type").alias("context"), (F.col("event_id") % 10 == 0).alias("error"), (F.col("event_id") % 500).alias("input_tokens"), (F.col("user_id") % 200).alias("output_tokens"), (F.col("event_id") % 70).alias("thinking_tokens"), (F.col("value") / 100).alias("latency"))
    u = Q.usage(calls, 0.3, 2.5)
    return u.select("context", "calls", "errors", "input_tokens", "output_tokens", "thinking_tokens", F.round("latency", 4).alias("latency"), r6("avg_latency").alias("avg_latency"), r6("cost").alias("cost"))


GATES = f"{FEATURES_SQL}{TRUTH}, ab AS (SELECT m.mode, truth, CASE WHEN label = 'Mild' AND mild_ok THEN 'Mild' WHEN label = 'Mild' THEN 'Moderate' WHEN m.mode = 'none' THEN label WHEN m.mode = 'regex' THEN CASE WHEN label = 'Severe' AND (raw_sev < 0.5 OR raw_sev - raw_mod < 0.05) THEN 'Moderate' ELSE label END WHEN gate_p >= 0.15 THEN 'Severe' ELSE 'Moderate' END AS found FROM ga JOIN tr USING (text_id), (VALUES ('none'), ('regex'), ('learned')) m(mode) WHERE truth IS NOT NULL)"


@query(f"WITH {GATES} SELECT mode, count(*) AS n, round(avg((truth = found)::INT), 6) AS accuracy, count(*) FILTER (found = 'Severe') AS severe FROM ab GROUP BY mode")
def ablation_union(spark: SparkSession, d: str) -> DataFrame:
    """The gate's modes side by side."""
    from . import severity as SV

    truth = gate_scores(spark, d).select("text_id", "truth")
    parts = [f(spark, d).select(F.lit(mode).alias("mode"), "text_id", F.col("severity").alias("found")) for mode, f in (("none", SV.gate_decision_none), ("regex", SV.gate_decision_regex), ("learned", SV.gate_decision_learned))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(truth, "text_id")
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("truth") == F.col("found")).cast("int"))).alias("accuracy"), F.count_if(F.col("found") == "Severe").alias("severe"))


@query(f"WITH {FEATURES_SQL}{TRUTH}, gs AS (SELECT ga.text_id, gate_p, truth FROM ga JOIN tr USING (text_id) WHERE truth IS NOT NULL), lo AS (SELECT 'lowest_severe' AS kind, text_id, gate_p FROM gs WHERE truth = 'Severe' ORDER BY round(gate_p, 9), text_id LIMIT 5), hi AS (SELECT 'highest_other' AS kind, text_id, gate_p FROM gs WHERE truth <> 'Severe' ORDER BY round(gate_p, 9) DESC, text_id LIMIT 8) SELECT kind, text_id, round(gate_p, 6) AS gate_p FROM (SELECT * FROM lo UNION ALL SELECT * FROM hi)")
def oof_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The five lowest scores of Severe texts and the eight highest of others: a top-k report."""
    rows = gate_scores(spark, d)
    low = rows.where("truth = 'Severe'").orderBy(F.round("gate_p", 9), "text_id").limit(5).select(F.lit("lowest_severe").alias("kind"), "text_id", "gate_p")
    high = rows.where("truth != 'Severe'").orderBy(F.desc(F.round("gate_p", 9)), "text_id").limit(8).select(F.lit("highest_other").alias("kind"), "text_id", "gate_p")
    return low.unionByName(high).select("kind", "text_id", r6("gate_p").alias("gate_p"))


@query(f"WITH {EV}, r AS (SELECT prescription_id, run_name, gt_severity, pred_severity, CASE WHEN gt_severity = 'Severe' AND pred_severity <> 'Severe' THEN 0 WHEN gt_severity <> pred_severity THEN 1 ELSE 2 END AS tier FROM ev) SELECT prescription_id, run_name, gt_severity, pred_severity, tier FROM r ORDER BY tier, md5('3|' || prescription_id || '|' || run_name) LIMIT 50")
def spot_check_pick(spark: SparkSession, d: str) -> DataFrame:
    """Fifty rows to look at: missed Severe ones first, then other disagreements, then fill, in hashed order."""
    tier = F.when((F.col("gt_severity") == "Severe") & (F.col("pred_severity") != "Severe"), 0).when(F.col("gt_severity") != F.col("pred_severity"), 1).otherwise(2)
    rows = evals(spark, d).select("prescription_id", "run_name", "gt_severity", "pred_severity", tier.alias("tier"))
    return rows.orderBy("tier", F.md5(F.concat_ws("|", F.lit("3"), "prescription_id", "run_name"))).limit(50)


@query()
def stacker_cv(spark: SparkSession, d: str) -> DataFrame:
    """Mean accuracy of a multinomial stack over a small grid of penalties, by five-fold cross-validation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from .severity import logits, softmax

    rows = logits(spark, d).select("vec_id", (F.col("label") % 3).cast("double").alias("y"), softmax(F.col("a"), 1.5).alias("pa"), softmax(F.col("b"), 0.8).alias("pb"))
    flat = rows.select("vec_id", "y", *(F.col(p)[k].alias(f"{p}{k}") for p in ("pa", "pb") for k in range(3)))
    ready = VectorAssembler(inputCols=[f"{p}{k}" for p in ("pa", "pb") for k in range(3)], outputCol="x").transform(flat)
    lr = LogisticRegression(featuresCol="x", labelCol="y", maxIter=30)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1, 1.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), numFolds=5, seed=3, parallelism=2)
    model = cv.fit(ready)
    return spark.createDataFrame([(float(p[lr.regParam]), round(float(m), 6)) for p, m in zip(grid, model.avgMetrics)], "penalty double, accuracy double")
