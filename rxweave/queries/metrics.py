"""Evaluation metrics over the evaluation rows, the annotators and vector stand-ins for model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity as S
from ..operators import metrics as M
from ..sources.tables import table
from .pairs import RANK
from .registry import EV, evals, query, r6
from .severity import LOGITS, RISK_SQL, logits, softmax, softmax_sql

OUT = "(VALUES ('No Interaction'), ('Mild'), ('Moderate'), ('Severe'))"
CELLS = f"""{EV}, cells AS (SELECT t.l AS truth, p.l AS found, (SELECT count(*) FROM ev WHERE gt_severity = t.l AND pred_severity = p.l) AS n FROM {OUT} t(l), {OUT} p(l)),
per AS (SELECT label, support, predicted, hits, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM (
    SELECT l AS label, (SELECT sum(n) FROM cells WHERE truth = l)::DOUBLE AS support, (SELECT sum(n) FROM cells WHERE found = l)::DOUBLE AS predicted, (SELECT sum(n) FROM cells WHERE found = l AND truth = l)::DOUBLE AS hits FROM {OUT} x(l))),
rep AS (SELECT label, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, support, predicted FROM per)"""


@query(f"WITH {CELLS} SELECT truth, found, n FROM cells")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(evals(spark, d), "gt_severity", "pred_severity", S.OUTCOMES)


@query(f"WITH {CELLS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM rep")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    rep = M.class_report(evals(spark, d), "gt_severity", "pred_severity", S.OUTCOMES)
    return rep.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@query(
    f"""WITH {CELLS} SELECT (SELECT sum(n) FROM cells)::BIGINT AS n, round((SELECT sum(n) FILTER (truth = found) / sum(n) FROM cells), 6) AS accuracy,
    round((SELECT avg(f1) FROM rep WHERE support > 0 OR predicted > 0), 6) AS macro_f1, round((SELECT sum(f1 * support) / sum(support) FROM rep), 6) AS weighted_f1"""
)
def accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    s = M.summary(evals(spark, d), "gt_severity", "pred_severity", S.OUTCOMES)
    return s.select("n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), r6("weighted_f1").alias("weighted_f1"))


SERIOUS = "(CASE gt_severity WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Mild' THEN 1 ELSE 0 END >= 2)"
RISKS = f"{EV}, rk AS (SELECT {SERIOUS} AS pos, {RISK_SQL.format('pred_severity')} - coalesce(latency_seconds, 0) / 100 AS score, run_name FROM ev)"


def risks(spark: SparkSession, d: str) -> DataFrame:
    """Serious or not (Moderate and up), and a risk score that the latency spreads."""
    rows = evals(spark, d)
    score = S.risk_score(F.col("pred_severity")) - F.coalesce("latency_seconds", F.lit(0.0)) / 100
    return rows.select((S.rank(F.col("gt_severity")) >= 2).alias("pos"), score.alias("score"), "run_name")


@query(
    f"""WITH {RISKS}, c AS (SELECT count(*) FILTER (pos AND score >= 0.5)::DOUBLE AS tp, count(*) FILTER (NOT pos AND score >= 0.5)::DOUBLE AS fp, count(*) FILTER (pos AND score < 0.5)::DOUBLE AS fn, count(*) FILTER (NOT pos AND score < 0.5)::DOUBLE AS tn FROM rk)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = M.binary(risks(spark, d), F.col("pos"), F.col("score") >= 0.5)
    return b.select("tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in ("sensitivity", "specificity", "precision", "f1")))


ROC = f"""{RISKS}, sc AS (SELECT score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM rk GROUP BY score),
roc AS (SELECT score AS threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp, sum(p) OVER w / (SELECT sum(p) FROM sc) AS tpr, sum(n) OVER w / (SELECT sum(n) FROM sc) AS fpr FROM sc WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {ROC} SELECT round(threshold, 9) AS threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = M.roc(risks(spark, d), "score", F.col("pos"))
    return curve.select(F.round("threshold", 9).alias("threshold"), "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(
    f"""WITH {RISKS}, sc AS (SELECT score, count(*) FILTER (pos)::DOUBLE AS p, count(*) FILTER (NOT pos)::DOUBLE AS n FROM rk GROUP BY score),
b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b"""
)
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(risks(spark, d), "score", F.col("pos")).select(r6("auc").alias("auc"))


# The thresholds of the decision curve.
THRESHOLDS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(
    f"""WITH {RISKS}, g AS (SELECT t::DOUBLE AS t FROM (VALUES {", ".join(f"({t})" for t in THRESHOLDS)}) v(t)), c AS (SELECT t, count(*) AS n, count(*) FILTER (pos AND score >= t) AS tp, count(*) FILTER (NOT pos AND score >= t) AS fp FROM rk, g GROUP BY t)
SELECT t AS threshold, n, tp, fp, round(tp / n - fp / n * t / (1 - t), 6) AS net_benefit FROM c"""
)
def net_benefit(spark: SparkSession, d: str) -> DataFrame:
    return M.net_benefit(risks(spark, d), "score", F.col("pos"), THRESHOLDS).select("threshold", "n", "tp", "fp", r6("net_benefit").alias("net_benefit"))


@query(
    f"""WITH {RISKS}, b AS (SELECT least(floor(greatest(score, 0) * 10), 9)::INT AS bin, greatest(score, 0) AS score, pos FROM rk)
SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(pos::INT), 6) AS positive_share FROM b GROUP BY bin"""
)
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = risks(spark, d).withColumn("score", F.greatest("score", F.lit(0.0)))
    return M.calibration(rows, "score", F.col("pos")).select("bin", "n", r6("mean_score").alias("mean_score"), r6("positive_share").alias("positive_share"))


@query(
    f"""WITH {ROC}, a AS (SELECT threshold, fpr * 80 AS fatigue, (1 - tpr) * 20 AS missed FROM roc), n AS (SELECT *, pow(fatigue / 80, 2) + pow(missed / 20, 2) AS dist FROM a)
SELECT round(threshold, 9) AS threshold, round(fatigue, 6) AS fatigue, round(missed, 6) AS missed FROM n ORDER BY round(dist, 9), threshold DESC LIMIT 1"""
)
def alert_fatigue(spark: SparkSession, d: str) -> DataFrame:
    """The threshold with the smallest normalised distance of needless alerts and misses from none."""
    curve = M.roc(risks(spark, d), "score", F.col("pos"))
    rows = curve.select("threshold", (F.col("fpr") * 80).alias("fatigue"), ((1 - F.col("tpr")) * 20).alias("missed"))
    dist = F.pow(F.col("fatigue") / 80, 2) + F.pow(F.col("missed") / 20, 2)
    best = rows.orderBy(F.round(dist, 9), F.desc("threshold")).limit(1)
    return best.select(F.round("threshold", 9).alias("threshold"), r6("fatigue").alias("fatigue"), r6("missed").alias("missed"))


@query(f"WITH {ROC} SELECT 'roc' AS chart, round(threshold, 9) AS x_key, round(fpr, 6) AS x, round(tpr, 6) AS y FROM roc UNION ALL SELECT 'decision', t, t, round(tp / n - fp / n * t / (1 - t), 6) FROM (SELECT t::DOUBLE AS t, count(*) AS n, count(*) FILTER (pos AND score >= t) AS tp, count(*) FILTER (NOT pos AND score >= t) AS fp FROM rk, (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) v(t) GROUP BY t)")
def chart_data_roc_decision(spark: SparkSession, d: str) -> DataFrame:
    """The points of the ROC and the decision curve as one table for plotting."""
    rows = risks(spark, d)
    curve = M.roc(rows, "score", F.col("pos")).select(F.lit("roc").alias("chart"), F.round("threshold", 9).alias("x_key"), r6("fpr").alias("x"), r6("tpr").alias("y"))
    decision = M.net_benefit(rows, "score", F.col("pos"), THRESHOLDS).select(F.lit("decision").alias("chart"), F.col("threshold").alias("x_key"), F.col("threshold").alias("x"), r6("net_benefit").alias("y"))
    return curve.unionByName(decision)


@query(f"WITH {EV} SELECT run_name, sum(gt_drug_count)::BIGINT AS drugs, sum(missed_drug_count)::BIGINT AS missed, round((sum(gt_drug_count) - sum(missed_drug_count)) / sum(gt_drug_count), 6) AS match_rate FROM ev GROUP BY run_name")
def drug_match_rate(spark: SparkSession, d: str) -> DataFrame:
    agg = evals(spark, d).groupBy("run_name").agg(F.sum("gt_drug_count").alias("drugs"), F.sum("missed_drug_count").alias("missed"))
    return agg.select("run_name", "drugs", "missed", r6(M.ratio(F.col("drugs") - F.col("missed"), F.col("drugs"))).alias("match_rate"))


STATS = """count({0}) AS n, round(coalesce(avg({0}), 0), 6) AS mean, round(coalesce(stddev_pop({0}), 0), 6) AS std, coalesce(min({0}), 0) AS min, coalesce(max({0}), 0) AS max, round(1 - least(coalesce(stddev_pop({0}), 0), 1), 6) AS confidence,
    round(quantile_cont({0}, 0.025), 6) AS ci95_low, round(quantile_cont({0}, 0.975), 6) AS ci95_high, round(quantile_cont({0}, 0.005), 6) AS ci99_low, round(quantile_cont({0}, 0.995), 6) AS ci99_high"""


@query(f"WITH {EV} SELECT run_name, {STATS.format('latency_seconds')} FROM ev GROUP BY run_name")
def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    out = M.describe(evals(spark, d), "latency_seconds", ["run_name"])
    return out.select("run_name", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", *(r6(c).alias(c) for c in ("confidence", "ci95_low", "ci95_high", "ci99_low", "ci99_high")))


@query(
    f"""WITH {EV}, p AS (SELECT DISTINCT prescription_id, run_name, pow(latency_seconds, 1 / 1.5::DOUBLE) AS s FROM ev WHERE latency_seconds IS NOT NULL), t AS (SELECT run_name, sum(s) AS total, count(*) AS n FROM p GROUP BY 1)
SELECT prescription_id, run_name, round(s / total * n, 6) AS calibrated FROM p JOIN t USING (run_name)"""
)
def confidence_calibrate(spark: SparkSession, d: str) -> DataFrame:
    """Power temperature 1.5 over the scores of a run, scaled to a sum of their number."""
    rows = evals(spark, d).where("latency_seconds is not null").select("prescription_id", "run_name", F.pow("latency_seconds", F.lit(1 / 1.5)).alias("s")).distinct()
    total = rows.groupBy("run_name").agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(total), "run_name").select("prescription_id", "run_name", r6(F.col("s") / F.col("total") * F.col("n")).alias("calibrated"))


@query(
    f"""WITH {LOGITS}, m AS (SELECT vec_id, i, [a[i], b[i]] AS v FROM l, range(1, 4) r(i)), e AS (SELECT vec_id, avg(list_avg(v)) AS ensemble_mean, avg(list_var_pop(v)) AS variance FROM m GROUP BY 1)
SELECT vec_id, round(ensemble_mean, 6) AS ensemble_mean, round(variance, 6) AS uncertainty, round(1 - least(variance, 1), 6) AS confidence, round(1 - variance, 6) AS agreement FROM e"""
)
def ensemble_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population variance over models per element, then over the elements."""
    rows = logits(spark, d).select("vec_id", F.explode(F.arrays_zip("a", "b")).alias("v"))
    mean, diff = (F.col("v.a") + F.col("v.b")) / 2, (F.col("v.a") - F.col("v.b")) / 2
    per = rows.groupBy("vec_id").agg(F.avg(mean).alias("m"), F.avg(diff * diff).alias("var"))
    return per.select("vec_id", r6("m").alias("ensemble_mean"), r6("var").alias("uncertainty"), r6(1 - F.least("var", F.lit(1.0))).alias("confidence"), r6(1 - F.col("var")).alias("agreement"))


@query(
    f"""WITH {LOGITS}, s AS (SELECT vec_id, label % 3 AS y, {softmax_sql("a", 1.0)} AS pa, {softmax_sql("b", 1.0)} AS pb FROM l),
acc AS (SELECT avg((list_position(pa, list_max(pa)) - 1 = y)::INT) AS ra, avg((list_position(pb, list_max(pb)) - 1 = y)::INT) AS rb FROM s),
w AS (SELECT vec_id, list_transform(list_zip(pa, pb), lambda x: (x[1] * ra * ra + x[2] * rb * rb) / (ra * ra + rb * rb)) AS p FROM s, acc)
SELECT vec_id, list_transform(p, lambda x: round(x, 6)) AS p, list_position(p, list_max(p)) - 1 AS class_index FROM w"""
)
def weighted_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Class probabilities weighted by the squared accuracy of each member."""
    rows = logits(spark, d).select("vec_id", (F.col("label") % 3).alias("y"), softmax(F.col("a"), 1.0).alias("pa"), softmax(F.col("b"), 1.0).alias("pb"))
    hit = lambda p: (F.array_position(p, F.array_max(p)) - 1 == F.col("y")).cast("int")
    acc = rows.agg(F.avg(hit("pa")).alias("ra"), F.avg(hit("pb")).alias("rb"))
    wa, wb = F.col("ra") * F.col("ra"), F.col("rb") * F.col("rb")
    mixed = rows.crossJoin(F.broadcast(acc)).select("vec_id", F.zip_with("pa", "pb", lambda x, y: (x * wa + y * wb) / (wa + wb)).alias("p"))
    return mixed.select("vec_id", F.transform("p", lambda x: F.round(x, 6)).alias("p"), (F.array_position("p", F.array_max("p")) - 1).alias("class_index"))


@query(f"WITH {LOGITS} SELECT i AS a_class, j AS b_class, round(corr(a[i + 1], b[j + 1]), 6) AS r FROM l, range(3) x(i), range(3) y(j) GROUP BY i, j")
def model_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlation of the members' outputs, class by class."""
    rows = logits(spark, d)
    grid = [(i, j) for i in range(3) for j in range(3)]
    wide = rows.agg(*(F.corr(F.col("a")[i], F.col("b")[j]).alias(f"r{i}{j}") for i, j in grid))
    cells = F.array(*(F.struct(F.lit(i).cast("bigint").alias("a_class"), F.lit(j).cast("bigint").alias("b_class"), r6(f"r{i}{j}").alias("r")) for i, j in grid))
    return wide.select(F.explode(cells).alias("x")).select("x.*")


@query(
    """WITH r AS (SELECT DISTINCT prescription_id, complexity FROM keyword_smoke10), ev AS (SELECT DISTINCT * FROM detailed_results), j AS (SELECT complexity, (gt_severity = pred_severity)::INT AS ok FROM ev JOIN r USING (prescription_id))
SELECT complexity, count(*) AS n, round(avg(ok), 6) AS accuracy FROM j GROUP BY complexity UNION ALL SELECT 'overall', count(*), round(avg(ok), 6) FROM j"""
)
def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "keyword_smoke10").select("prescription_id", "complexity").distinct()
    rows = evals(spark, d).join(kinds, "prescription_id").select("complexity", (F.col("gt_severity") == F.col("pred_severity")).cast("int").alias("ok"))
    rolled = rows.rollup("complexity").agg(F.grouping("complexity").alias("g"), F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"))
    return rolled.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("complexity")).alias("complexity"), "n", r6("accuracy").alias("accuracy"))


@query(
    f"""WITH {EV}, x AS (SELECT run_name, l, count(*) FILTER (gt_severity = l AND pred_severity = l)::DOUBLE AS tp, count(*) FILTER (gt_severity = l)::DOUBLE AS s, count(*) FILTER (pred_severity = l)::DOUBLE AS p FROM ev, {OUT} o(l) GROUP BY ALL),
f AS (SELECT run_name, l, s, CASE WHEN s + p > 0 THEN 2 * tp / (s + p) ELSE 0 END AS f1 FROM x)
SELECT run_name, round(sum(f1 * s) / sum(s), 6) AS weighted_f1, round(max(f1) FILTER (l = 'No Interaction'), 6) AS f1_no_interaction, round(max(f1) FILTER (l = 'Mild'), 6) AS f1_mild,
    round(max(f1) FILTER (l = 'Moderate'), 6) AS f1_moderate, round(max(f1) FILTER (l = 'Severe'), 6) AS f1_severe FROM f GROUP BY run_name"""
)
def config_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Weighted F1 and F1 per outcome, one row per configuration."""
    rows = evals(spark, d)
    labels = F.array(*map(F.lit, S.OUTCOMES))
    per = rows.select("run_name", "gt_severity", "pred_severity", F.explode(labels).alias("l")).groupBy("run_name", "l").agg(
        F.count_if((F.col("gt_severity") == F.col("l")) & (F.col("pred_severity") == F.col("l"))).alias("tp"), F.count_if(F.col("gt_severity") == F.col("l")).alias("s"), F.count_if(F.col("pred_severity") == F.col("l")).alias("p")
    )
    f1 = per.select("run_name", "l", "s", M.ratio(2 * F.col("tp"), F.col("s") + F.col("p")).alias("f1"))
    pick = lambda label: r6(F.max(F.when(F.col("l") == label, F.col("f1"))))
    return f1.groupBy("run_name").agg(r6(F.sum(F.col("f1") * F.col("s")) / F.sum("s")).alias("weighted_f1"), *(pick(x).alias("f1_" + x.lower().replace(" ", "_")) for x in S.OUTCOMES))


@query(
    f"""WITH {EV}, m AS (SELECT run_name, avg((gt_severity = pred_severity)::INT) AS acc, avg(latency_seconds) AS lat FROM ev GROUP BY 1)
SELECT m.run_name, round(m.acc, 6) AS accuracy, round(m.acc - b.acc, 6) AS accuracy_delta, round(m.lat - b.lat, 6) AS latency_delta FROM m, (SELECT * FROM m WHERE run_name = 'keyword_v1') b"""
)
def split_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Each run against the baseline run."""
    m = evals(spark, d).groupBy("run_name").agg(F.avg((F.col("gt_severity") == F.col("pred_severity")).cast("int")).alias("acc"), F.avg("latency_seconds").alias("lat"))
    base = m.where("run_name = 'keyword_v1'").select(F.col("acc").alias("acc0"), F.col("lat").alias("lat0"))
    return m.crossJoin(F.broadcast(base)).select("run_name", r6("acc").alias("accuracy"), r6(F.col("acc") - F.col("acc0")).alias("accuracy_delta"), r6(F.col("lat") - F.col("lat0")).alias("latency_delta"))


@query(f"WITH {EV} SELECT run_name, round(greatest(10, 100 / (1 + avg(latency_seconds))), 6) AS speed, round(greatest(10, 100 - least(90, sum(pred_interactions_count) * 0.0000425::DOUBLE / count(*) * 1e4)), 6) AS cost FROM ev GROUP BY 1")
def radar_normalize(spark: SparkSession, d: str) -> DataFrame:
    cost = F.sum("pred_interactions_count") * 0.0000425 / F.count(F.lit(1)) * 1e4
    return evals(spark, d).groupBy("run_name").agg(r6(F.greatest(F.lit(10.0), 100 / (1 + F.avg("latency_seconds")))).alias("speed"), r6(F.greatest(F.lit(10.0), 100 - F.least(F.lit(90.0), cost))).alias("cost"))


@query(
    f"""WITH {LOGITS}, s AS (SELECT label % 3 AS y, list_position(a, list_max(a)) - 1 AS k, {softmax_sql("a", 1.0)} AS p FROM l),
f AS (SELECT c, 2.0 * count(*) FILTER (y = c AND k = c) / (count(*) FILTER (y = c) + count(*) FILTER (k = c)) AS f1 FROM s, range(3) r(c) GROUP BY c),
sc AS (SELECT p[2] + p[3] AS score, count(*) FILTER (y >= 1)::DOUBLE AS ps, count(*) FILTER (y = 0)::DOUBLE AS ns FROM s GROUP BY 1), b AS (SELECT ps, ns, coalesce(sum(ns) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc)
SELECT round((SELECT avg(f1) FROM f), 6) AS macro_f1, round((SELECT avg((y = k)::INT) FROM s), 6) AS accuracy, round((SELECT sum(ps * (below + ns / 2)) / (sum(ps) * sum(ns)) FROM b), 6) AS auc"""
)
def logit_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Macro F1 and accuracy of the largest logit, and the AUC of the chance of class 1 or higher."""
    names = ("0", "1", "2")
    rows = logits(spark, d).select((F.col("label") % 3).cast("string").alias("y"), (F.array_position("a", F.array_max("a")) - 1).cast("string").alias("k"), softmax(F.col("a"), 1.0).alias("p"))
    s = M.summary(rows, "y", "k", names).select(r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"))
    risk = rows.select((F.col("y") != "0").alias("pos"), (F.col("p")[1] + F.col("p")[2]).alias("score"))
    return s.crossJoin(M.auc(risk, "score", F.col("pos")).select(r6("auc").alias("auc")))


ROUNDS = "rounds AS (SELECT DISTINCT id, round_no, agentA, agentB FROM conflicts)"


def two_labels(spark: SparkSession, d: str) -> DataFrame:
    """Both labels of every labelling round, strictly normalised; rounds with an unreadable label are left out."""
    rows = table(spark, d, "conflicts").select("id", "round_no", "agentA", "agentB").distinct()
    return rows.select("id", "round_no", S.normalize(F.col("agentA"), strict=True).alias("a"), S.normalize(F.col("agentB"), strict=True).alias("b")).where("a is not null and b is not null")


def strict_sql(c: str) -> str:
    return f"CASE trim(regexp_replace(regexp_replace(upper(trim(coalesce({c}, ''))), '[^A-Z\\s]', '', 'g'), '\\s+', ' ', 'g')) WHEN 'MILD' THEN 'Mild' WHEN 'MODERATE' THEN 'Moderate' WHEN 'SEVERE' THEN 'Severe' WHEN 'VERY SEVERE' THEN 'Severe' END"


TWO = f"{ROUNDS}, two AS (SELECT * FROM (SELECT id, round_no, {strict_sql('agentA')} AS a, {strict_sql('agentB')} AS b FROM rounds) WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(
    f"""WITH {TWO}, n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS same FROM two), m AS (SELECT l, count(*) FILTER (a = l)::DOUBLE AS na, count(*) FILTER (b = l)::DOUBLE AS nb FROM two, (VALUES ('Mild'), ('Moderate'), ('Severe')) v(l) GROUP BY l),
e AS (SELECT sum(na * nb) / (SELECT n * n FROM n) AS e FROM m) SELECT n::BIGINT AS pairs, same::BIGINT AS agree, round(same / n, 6) AS agreement, round((same / n - e) / (1 - e), 6) AS kappa FROM n, e"""
)
def annotator_agreement(spark: SparkSession, d: str) -> DataFrame:
    cells = two_labels(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("same"))
    margins = cells.select(F.explode(F.array(F.struct(F.col("a").alias("l"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")), F.struct(F.col("b").alias("l"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")))).alias("x"))
    chance = margins.groupBy("x.l").agg((F.sum("x.na") * F.sum("x.nb")).alias("p")).agg(F.sum("p").alias("p"))
    share, e = F.col("same") / F.col("n"), F.col("p") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select(F.col("n").alias("pairs"), F.col("same").alias("agree"), r6(share).alias("agreement"), r6((share - e) / (1 - e)).alias("kappa"))


@query(f"WITH {TWO} SELECT id, round_no, a, b FROM two WHERE a <> b")
def annotator_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return two_labels(spark, d).where("a != b")


@query(f"WITH {TWO} SELECT a AS label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM two GROUP BY a")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    counts = two_labels(spark, d).groupBy(F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", r6(100.0 * F.col("n") / F.col("total")).alias("percent"))


@query(f"WITH {TWO}, c AS (SELECT l, greatest(count(*) FILTER (a = l), 1)::DOUBLE AS n FROM two, (VALUES ('Mild'), ('Moderate'), ('Severe')) v(l) GROUP BY l), w AS (SELECT l, (SELECT sum(n) FROM c) / n AS w FROM c) SELECT l AS label, round(w / (SELECT sum(w) FROM w) * 3, 6) AS weight FROM w")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Inverse class frequencies, scaled to a sum of three; an empty class counts one."""
    rows = two_labels(spark, d)
    counts = M.label_frame(rows, S.LABELS, "label").select("label").join(rows.groupBy(F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("n")), "label", "left")
    n = counts.select("label", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("n"))
    inverse = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("label", (F.col("total") / F.col("n")).alias("w"))
    return inverse.crossJoin(F.broadcast(inverse.agg(F.sum("w").alias("sum")))).select("label", r6(F.col("w") / F.col("sum") * 3).alias("weight"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals of accuracy, macro F1 and binary F1 (any interaction or none) over 500 draws."""
    out = M.bootstrap_classes(evals(spark, d), "gt_severity", "pred_severity", ["Mild", "Moderate", "Severe"], 500, 7)
    return out.select("metric", *(r6(c).alias(c) for c in ("mean", "low", "high")))


@query()
def bootstrap_diff(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of the accuracy gain of one run over the other on common prescriptions, and the chance of a gain."""
    rows = evals(spark, d).groupBy("prescription_id").pivot("run_name", ["keyword_v1", "ensemble_v2"]).agg(F.max((F.col("gt_severity") == F.col("pred_severity")).cast("int"))).dropna()
    out = M.bootstrap(rows, F.col("ensemble_v2") - F.col("keyword_v1"), 500, 11)
    return out.select(*(r6(c).alias(c) for c in ("mean", "low", "high")), r6("above").alias("p_better"))
