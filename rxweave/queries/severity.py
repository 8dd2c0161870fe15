"""Severity labels, cascades, gates, probability stacks and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity as S
from ..operators import metrics as M
from ..plans.session import literal_rows
from ..sources.tables import table
from .pairs import LABEL, RANK, keyword_sql
from .registry import PR, SCORED, query, r6, rx, rx_pairs, scored


@query(f"WITH {PR}, per AS (SELECT prescription_id, max({RANK.format('ground_truth_severity')}) AS worst FROM pr GROUP BY 1) SELECT prescription_id, {LABEL.format('coalesce(worst, 0)')} AS max_severity FROM rx LEFT JOIN per USING (prescription_id)")
def max_severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    per = rx_pairs(spark, d).groupBy("prescription_id").agg(S.max_label(F.col("ground_truth_severity")).alias("max_severity"))
    return rx(spark, d).select("prescription_id").join(per, "prescription_id", "left").select("prescription_id", F.coalesce("max_severity", F.lit(S.NO_INTERACTION)).alias("max_severity"))


RISK_SQL = "CASE {0} WHEN 'Severe' THEN 0.95 WHEN 'Moderate' THEN 0.75 WHEN 'Mild' THEN 0.25 ELSE 0.05 END::DOUBLE"


@query(f"WITH {PR}, {SCORED}, per AS (SELECT prescription_id, max(coalesce(CASE WHEN pos % 2 = 0 THEN p_mod + p_sev END, {RISK_SQL.format('ground_truth_severity')})) AS risk FROM sc GROUP BY 1) SELECT prescription_id, round(coalesce(risk, 0.05::DOUBLE), 6) AS risk FROM rx LEFT JOIN per USING (prescription_id)")
def max_risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Highest risk per prescription: the scorer's where it gave one (every other pair), else the label's."""
    pairs = scored(rx_pairs(spark, d))
    own = F.when(F.col("pos") % 2 == 0, F.col("p_mod") + F.col("p_sev"))
    per = pairs.groupBy("prescription_id").agg(F.max(F.coalesce(own, S.risk_score(F.col("ground_truth_severity")))).alias("risk"))
    return rx(spark, d).select("prescription_id").join(per, "prescription_id", "left").select("prescription_id", r6(F.coalesce("risk", F.lit(0.05))).alias("risk"))


TEXTS = PR + ", dt AS (SELECT DISTINCT text_id, drugbank_description AS description FROM pr)"


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    return rx_pairs(spark, d).select("text_id", F.col("drugbank_description").alias("description")).distinct()


@query(f"WITH {TEXTS} SELECT text_id, {keyword_sql('description')} AS severity FROM dt")
def severity_cascade(spark: SparkSession, d: str) -> DataFrame:
    return descriptions(spark, d).select("text_id", S.keyword_severity(F.col("description")).alias("severity"))


def cue_sql(name: str, text: str = "description") -> str:
    return f"regexp_matches(coalesce({text}, ''), '(?i){S.CUES[name]}')"


MILD_SQL = f"""(regexp_matches(coalesce(description, ''), '(?i)gastrointestinal irritation') OR regexp_matches(coalesce(description, ''), '(?i)may decrease the (sedative|hypertensive)')
    OR regexp_matches(coalesce(description, ''), '(?i)hypertension can be decreased') OR regexp_matches(coalesce(description, ''), '(?i){S.MILD_PATTERNS[3]}')
    OR ({cue_sql("excretion")} AND NOT {cue_sql("serum")}))"""


@query(f"WITH {TEXTS} SELECT text_id, {MILD_SQL} AS genuinely_mild FROM dt")
def mild_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return descriptions(spark, d).select("text_id", S.is_genuinely_mild(F.col("description")).alias("genuinely_mild"))


CLEAN_SQL = "trim(regexp_replace(regexp_replace(upper(trim(coalesce({0}, ''))), '[^A-Z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
NORMAL_SQL = f"CASE {CLEAN_SQL} WHEN 'MILD' THEN 'Mild' WHEN 'MODERATE' THEN 'Moderate' WHEN 'SEVERE' THEN 'Severe' WHEN 'VERY SEVERE' THEN 'Severe' ELSE {{1}} END"


@query(
    f"""WITH raw AS (SELECT DISTINCT agentA AS raw FROM conflicts UNION SELECT DISTINCT agentB FROM conflicts),
n AS (SELECT raw, {NORMAL_SQL.format("raw", "'No Interaction'")} AS label, {NORMAL_SQL.format("raw", "NULL")} AS strict_label FROM raw)
SELECT raw, label, strict_label, {RANK.format("label")} AS rank, {RISK_SQL.format("label")} AS risk FROM n"""
)
def severity_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conflicts")
    raw = rows.select(F.explode(F.array("agentA", "agentB")).alias("raw")).distinct()
    c = F.col("raw")
    return raw.select("raw", S.normalize(c).alias("label"), S.normalize(c, strict=True).alias("strict_label"), S.rank(c).alias("rank"), S.risk_score(c).alias("risk"))


@query(
    f"""WITH {PR}, s AS (SELECT prescription_id, pos, {keyword_sql("drugbank_description")} AS database_severity, ground_truth_severity AS second FROM pr)
SELECT prescription_id, pos, database_severity, second, CASE WHEN {RANK.format("second")} > {RANK.format("database_severity")} THEN second ELSE database_severity END AS final_severity FROM s"""
)
def safety_first_combine(spark: SparkSession, d: str) -> DataFrame:
    rows = rx_pairs(spark, d).select("prescription_id", "pos", S.keyword_severity(F.col("drugbank_description")).alias("database_severity"), F.col("ground_truth_severity").alias("second"))
    return rows.withColumn("final_severity", S.safety_first(F.col("database_severity"), F.col("second")))


@query(f"WITH {TEXTS} SELECT text_id, {', '.join(f'{cue_sql(n)} AS {n}' for n in S.CUES)} FROM dt")
def cue_regexes(spark: SparkSession, d: str) -> DataFrame:
    return descriptions(spark, d).select("text_id", *(S.cue(F.col("description"), n).alias(n) for n in S.CUES))


P3 = ("p_mild", "p_mod", "p_sev")
CLIP = ", ".join(f"least(greatest({p}, 1e-9::DOUBLE), 1.0::DOUBLE) AS c_{p}" for p in P3)
b01 = lambda e: f"CASE WHEN {e} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
FEATURES_SQL = f"""{PR}, {SCORED}, d0 AS (SELECT DISTINCT text_id, drugbank_description AS description, p_mild, p_mod, p_sev FROM sc),
d1 AS (SELECT *, {CLIP} FROM d0), d2 AS (SELECT *, c_p_mild / (c_p_mild + c_p_mod + c_p_sev) AS q0, c_p_mod / (c_p_mild + c_p_mod + c_p_sev) AS q1, c_p_sev / (c_p_mild + c_p_mod + c_p_sev) AS q2,
    trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')) AS sq FROM d1),
gf AS (SELECT text_id, description, p_mod AS raw_mod, p_sev AS raw_sev, q0 AS p_mild, q1 AS p_mod, q2 AS p_sev, q2 - q1 AS p_sev_minus_p_mod, -(q0 * ln(q0) + q1 * ln(q1) + q2 * ln(q2)) AS entropy,
    CASE WHEN sq = '' THEN 0 ELSE len(string_split(sq, ' ')) END::DOUBLE AS n_words, {b01(cue_sql("qtc_torsades"))} AS cue_qtc_torsades,
    {b01(f"{cue_sql('bleed')} AND NOT {cue_sql('bleed_risk')}")} AS cue_bleed_event, {b01(f"{cue_sql('bleed')} AND {cue_sql('bleed_risk')}")} AS cue_bleed_risk,
    {", ".join(f"{b01(cue_sql(n))} AS cue_{n}" for n in ("arrhythmia", "rhabdo", "serotonin", "renal_failure", "organ_tox"))},
    {b01(f"{cue_sql('excretion')} AND {cue_sql('serum')}")} AS cue_excretion_serum, {b01(cue_sql("gi_only"))} AS cue_gi_only, {b01(cue_sql("severe_event"))} AS cue_severe_event FROM d2),
gp AS (SELECT *, 1 / (1 + exp(-({S.GATE_INTERCEPT}::DOUBLE + {" + ".join(f"{n} * ({w}::DOUBLE)" for n, w in S.GATE_WEIGHTS.items())}))) AS gate_p FROM gf),
ga AS (SELECT *, CASE WHEN p_mild >= p_mod AND p_mild >= p_sev THEN 'Mild' WHEN p_mod >= p_sev THEN 'Moderate' ELSE 'Severe' END AS label, raw_mod + raw_sev AS risk, {MILD_SQL} AS mild_ok FROM gp)"""


def gate_input(spark: SparkSession, d: str) -> DataFrame:
    """One row per description with probabilities, their largest label and risk."""
    rows = scored(rx_pairs(spark, d)).select("text_id", F.col("drugbank_description").alias("description"), *P3).distinct()
    a, b, c = (F.col(p) for p in P3)
    label = F.when((a >= b) & (a >= c), "Mild").when(b >= c, "Moderate").otherwise("Severe")
    return rows.withColumns({"label": label, "risk": b + c})


@query(f"WITH {FEATURES_SQL} SELECT text_id, {', '.join(f'round({n}, 6) AS {n}' for n in S.FEATURES)} FROM gf")
def gate_features(spark: SparkSession, d: str) -> DataFrame:
    features = S.gate_features(F.col("description"), *map(F.col, P3))
    return gate_input(spark, d).select("text_id", *(r6(features[n]).alias(n) for n in S.FEATURES))


@query(f"WITH {FEATURES_SQL} SELECT text_id, round(gate_p, 6) AS gate_p FROM gp")
def logistic_score(spark: SparkSession, d: str) -> DataFrame:
    return gate_input(spark, d).select("text_id", r6(S.gate_probability(F.col("description"), *map(F.col, P3))).alias("gate_p"))


def _decision(spark: SparkSession, d: str, mode: str) -> DataFrame:
    p = S.gate_probability(F.col("description"), *map(F.col, P3)) if mode == "learned" else None
    severity, risk = S.gated(F.col("label"), F.col("risk"), F.col("p_mod"), F.col("p_sev"), F.col("description"), mode, p)
    return gate_input(spark, d).select("text_id", "label", severity.alias("severity"), r6(risk).alias("risk"))


def decision_sql(other: str) -> str:
    return f"""WITH {FEATURES_SQL} SELECT text_id, label, CASE WHEN label = 'Mild' AND mild_ok THEN 'Mild' WHEN label = 'Mild' THEN 'Moderate' ELSE {other} END AS severity,
    round(CASE WHEN label = 'Mild' AND NOT mild_ok THEN greatest(risk, 0.75::DOUBLE) ELSE risk END, 6) AS risk FROM ga"""


@query(decision_sql("label"))
def gate_decision_none(spark: SparkSession, d: str) -> DataFrame:
    return _decision(spark, d, "none")


@query(decision_sql("CASE WHEN label = 'Severe' AND (raw_sev < 0.5 OR raw_sev - raw_mod < 0.05) THEN 'Moderate' ELSE label END"))
def gate_decision_regex(spark: SparkSession, d: str) -> DataFrame:
    return _decision(spark, d, "regex")


@query(decision_sql("CASE WHEN gate_p >= 0.15 THEN 'Severe' ELSE 'Moderate' END"))
def gate_decision_learned(spark: SparkSession, d: str) -> DataFrame:
    return _decision(spark, d, "learned")


@query(f"WITH {FEATURES_SQL} SELECT text_id, round(entropy, 6) AS entropy, round(p_mod + p_sev, 6) AS risk FROM gf")
def vector_entropy_risk(spark: SparkSession, d: str) -> DataFrame:
    p = S.clipped_probabilities([F.col(x) for x in P3])
    return gate_input(spark, d).select("text_id", r6(S.entropy(p)).alias("entropy"), r6(p[1] + p[2]).alias("risk"))


LOGITS = "l AS (SELECT vec_id, label, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS a, list_transform(embedding[4:6], lambda x: x::DOUBLE) AS b FROM embeddings)"


def logits(spark: SparkSession, d: str) -> DataFrame:
    """Two members' three logits per vector: the first six numbers of each embedding."""
    rows = table(spark, d, "embeddings")
    three = lambda at: F.transform(F.slice("embedding", at, 3), lambda x: x.cast("double"))
    return rows.select("vec_id", "label", three(1).alias("a"), three(4).alias("b"))


def softmax(values, t: float):
    top = F.array_max(values)
    raised = F.transform(values, lambda x: F.exp((x - top) / t))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def softmax_sql(v: str, t: float) -> str:
    raised = f"list_transform({v}, lambda x: exp((x - list_max({v})) / {t}::DOUBLE))"
    return f"list_transform({raised}, lambda x: x / list_sum({raised}))"


@query(
    f"""WITH {LOGITS}, s AS (SELECT vec_id, {softmax_sql("a", 1.5)} AS pa, {softmax_sql("b", 0.8)} AS pb FROM l), m AS (SELECT vec_id, list_transform(list_zip(pa, pb), lambda x: (x[1] + x[2]) / 2) AS p FROM s)
SELECT vec_id, round(p[1], 6) AS p_mild, round(p[2], 6) AS p_mod, round(p[3], 6) AS p_sev, list_position(p, list_max(p)) - 1 AS class_index, round(p[2] + p[3], 6) AS risk FROM m"""
)
def softmax_stack(spark: SparkSession, d: str) -> DataFrame:
    """Temperature softmax of both members, their mean, the largest class and the risk."""
    rows = logits(spark, d).select("vec_id", softmax(F.col("a"), 1.5).alias("pa"), softmax(F.col("b"), 0.8).alias("pb"))
    mean = rows.select("vec_id", F.zip_with("pa", "pb", lambda x, y: (x + y) / 2).alias("p"))
    p = F.col("p")
    return mean.select("vec_id", r6(p[0]).alias("p_mild"), r6(p[1]).alias("p_mod"), r6(p[2]).alias("p_sev"), (F.array_position("p", F.array_max("p")) - 1).alias("class_index"), r6(p[1] + p[2]).alias("risk"))


@query(
    f"""WITH {LOGITS}, s AS (SELECT vec_id, label % 3 AS y, {softmax_sql("a", 1.0)} AS p FROM l)
SELECT vec_id, round(-ln(p[y + 1]), 6) AS cross_entropy, round(-(0.9::DOUBLE * ln(p[y + 1]) + 0.1::DOUBLE / 3 * (ln(p[1]) + ln(p[2]) + ln(p[3]))), 6) AS smoothed, round(-pow(1 - p[y + 1], 2) * ln(p[y + 1]), 6) AS focal FROM s"""
)
def loss_eval(spark: SparkSession, d: str) -> DataFrame:
    """Cross entropy, its form with labels smoothed by 0.1, and the focal loss with gamma 2."""
    rows = logits(spark, d).select("vec_id", (F.col("label") % 3).alias("y"), softmax(F.col("a"), 1.0).alias("p"))
    p = F.col("p")
    py = F.element_at("p", F.col("y") + 1)
    spread = sum((F.ln(p[k]) for k in (1, 2)), F.ln(p[0]))
    return rows.select("vec_id", r6(-F.ln(py)).alias("cross_entropy"), r6(-(0.9 * F.ln(py) + 0.1 / 3 * spread)).alias("smoothed"), r6(-F.pow(1 - py, 2) * F.ln(py)).alias("focal"))


GRID = [x / 10 for x in range(5, 51)]


@query(
    f"""WITH {LOGITS}, g AS (SELECT (5 + i) / 10.0::DOUBLE AS t FROM range(46) r(i)), n AS (
    SELECT t, avg(-((a[label % 3 + 1] - list_max(a)) / t - ln(list_sum(list_transform(a, lambda x: exp((x - list_max(a)) / t)))))) AS nll FROM l, g GROUP BY t)
SELECT arg_min(t, (round(nll, 9), t)) AS temperature, round(min(nll), 6) AS nll FROM n"""
)
def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    """The temperature of 0.5 to 5 with the lowest mean negative log-likelihood."""
    grid = literal_rows(spark, t=GRID)
    rows = logits(spark, d).crossJoin(F.broadcast(grid))
    top = F.array_max("a")
    log_sum = F.ln(F.aggregate(F.transform("a", lambda x: F.exp((x - top) / F.col("t"))), F.lit(0.0), lambda s, x: s + x))
    nll = -((F.element_at("a", F.col("label") % 3 + 1) - top) / F.col("t") - log_sum)
    per = rows.groupBy("t").agg(F.avg(nll).alias("nll"))
    return per.agg(F.min_by("t", F.struct(F.round("nll", 9), "t")).alias("temperature"), r6(F.min("nll")).alias("nll"))


@query(
    """WITH s AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_transform(embedding[1:4], lambda x: abs(x)::DOUBLE) ELSE list_transform(embedding[1:3], lambda x: abs(x)::DOUBLE) END AS soft,
    CASE WHEN vec_id % 5 = 0 THEN NULL ELSE label % 3 END AS llm_label, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label END AS own FROM embeddings)
SELECT vec_id, list_transform(CASE WHEN len(soft) = 4 THEN [soft[1] + soft[2], soft[3], soft[4]] ELSE soft END, lambda x: round(x, 6)) AS soft3, coalesce(llm_label, own, 0) AS label FROM s"""
)
def soft_label_merge(spark: SparkSession, d: str) -> DataFrame:
    """Four-class soft labels brought to three by adding the first two; the label falls back from one source to the next."""
    e = table(spark, d, "embeddings")
    n = F.when(F.col("vec_id") % 2 == 0, 4).otherwise(3)
    soft = e.select("vec_id", "label", F.transform(F.slice("embedding", F.lit(1), n), lambda x: F.abs(x).cast("double")).alias("soft"))
    merged = F.when(F.size("soft") == 4, F.array(F.col("soft")[0] + F.col("soft")[1], F.col("soft")[2], F.col("soft")[3])).otherwise(F.col("soft"))
    first = F.when(F.col("vec_id") % 5 != 0, F.col("label") % 3)
    own = F.when(F.col("vec_id") % 7 != 0, F.col("label"))
    return soft.select("vec_id", F.transform(merged, lambda x: F.round(x, 6)).alias("soft3"), F.coalesce(first, own, F.lit(0)).alias("label"))


TRUTH = ", tr AS (SELECT text_id, max(ground_truth_severity) AS truth FROM pr GROUP BY 1)"


def gate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Gate probability, truth and the stack's own label of every description with a severity."""
    truth = rx_pairs(spark, d).groupBy("text_id").agg(F.max("ground_truth_severity").alias("truth")).where("truth is not null")
    return gate_input(spark, d).select("text_id", "label", S.gate_probability(F.col("description"), *map(F.col, P3)).alias("gate_p")).join(truth, "text_id")


SWEEP = f"""{FEATURES_SQL}{TRUTH}, gs AS (SELECT ga.text_id, label, gate_p, truth FROM ga JOIN tr USING (text_id) WHERE truth IS NOT NULL),
grid AS (SELECT (10 + 5 * i) / 100.0::DOUBLE AS tau FROM range(17) r(i)), cells AS (SELECT tau, count(*) FILTER (gate_p >= tau AND truth = 'Severe')::DOUBLE AS tp,
    count(*) FILTER (gate_p >= tau AND truth <> 'Severe')::DOUBLE AS fp, count(*) FILTER (gate_p < tau AND truth = 'Severe')::DOUBLE AS fn FROM gs, grid GROUP BY tau)"""


@query(f"WITH {SWEEP} SELECT tau, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, fp::BIGINT AS overcalls, round(tp / (tp + fn), 6) AS sensitivity FROM cells ORDER BY round(2 * tp / (2 * tp + fp + fn), 9) DESC, fp, tp / (tp + fn) DESC, tau LIMIT 1")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The gate threshold of 0.10 to 0.90 with the best F1, then the fewest overcalls, then the best sensitivity."""
    grid = literal_rows(spark, tau=[(10 + 5 * k) / 100 for k in range(17)])
    severe = F.col("truth") == "Severe"
    called = F.col("gate_p") >= F.col("tau")
    cells = gate_scores(spark, d).crossJoin(F.broadcast(grid)).groupBy("tau").agg(F.count_if(called & severe).alias("tp"), F.count_if(called & ~severe).alias("fp"), F.count_if(~called & severe).alias("fn"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    f1, sens = M.ratio(2 * tp, 2 * tp + fp + fn), M.ratio(tp, tp + fn)
    best = cells.select("tau", f1.alias("f1"), fp.alias("overcalls"), sens.alias("sensitivity"))
    return best.orderBy(F.desc(F.round("f1", 9)), "overcalls", F.desc("sensitivity"), "tau").limit(1).select("tau", r6("f1").alias("f1"), "overcalls", r6("sensitivity").alias("sensitivity"))


@query(
    f"""WITH {FEATURES_SQL}{TRUTH}, gs AS (SELECT truth, CASE WHEN label = 'Mild' AND mild_ok THEN 'Mild' WHEN label = 'Mild' THEN 'Moderate' WHEN gate_p >= 0.15 THEN 'Severe' ELSE 'Moderate' END AS found FROM ga JOIN tr USING (text_id) WHERE truth IS NOT NULL),
c AS (SELECT count(*) FILTER (truth = 'Severe' AND found = 'Severe')::DOUBLE AS hit, count(*) FILTER (truth = 'Severe')::DOUBLE AS severe, count(*) FILTER (truth <> 'Severe' AND found = 'Severe') AS overcalls,
    count(*) FILTER (truth = 'Mild' AND found = 'Mild')::DOUBLE AS mm, count(*) FILTER (truth = 'Mild')::DOUBLE AS mt, count(*) FILTER (found = 'Mild')::DOUBLE AS mf FROM gs)
SELECT round(CASE WHEN severe > 0 THEN hit / severe ELSE 0 END, 6) AS severe_sensitivity, overcalls, round(CASE WHEN mt + mf > 0 THEN 2 * mm / (mt + mf) ELSE 0 END, 6) AS mild_f1 FROM c"""
)
def gate_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = S.gate_probability(F.col("description"), *map(F.col, P3))
    found, _ = S.gated(F.col("label"), F.col("risk"), F.col("p_mod"), F.col("p_sev"), F.col("description"), "learned", p)
    truth = rx_pairs(spark, d).groupBy("text_id").agg(F.max("ground_truth_severity").alias("truth")).where("truth is not null")
    rows = gate_input(spark, d).select("text_id", found.alias("found")).join(truth, "text_id")
    t, f = F.col("truth"), F.col("found")
    c = rows.agg(
        F.count_if((t == "Severe") & (f == "Severe")).alias("hit"), F.count_if(t == "Severe").alias("severe"), F.count_if((t != "Severe") & (f == "Severe")).alias("overcalls"),
        F.count_if((t == "Mild") & (f == "Mild")).alias("mm"), F.count_if(t == "Mild").alias("mt"), F.count_if(f == "Mild").alias("mf"),
    )
    return c.select(r6(M.ratio(F.col("hit"), F.col("severe"))).alias("severe_sensitivity"), "overcalls", r6(M.ratio(2 * F.col("mm"), F.col("mt") + F.col("mf"))).alias("mild_f1"))


@query()
def gate_train_oof(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of a weighted logistic gate (weights 10/2/1, C = 1) over five hashed folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    features = S.gate_features(F.col("description"), *map(F.col, P3))
    truth = rx_pairs(spark, d).groupBy("text_id").agg(F.max("ground_truth_severity").alias("truth")).where("truth is not null")
    rows = gate_input(spark, d).select("text_id", *(features[n].alias(n) for n in S.FEATURES)).join(truth, "text_id")
    weight = F.when(F.col("truth") == "Severe", 10.0).when(F.col("truth") == "Moderate", 2.0).otherwise(1.0)
    rows = rows.select("*", (F.col("truth") == "Severe").cast("double").alias("y"), weight.alias("w"), F.pmod(F.xxhash64("text_id"), F.lit(5)).alias("fold"))
    ready = VectorAssembler(inputCols=list(S.FEATURES), outputCol="x").transform(rows).select("text_id", "x", "y", "w", "fold").cache()
    total = ready.agg(F.sum("w")).first()[0] or 1.0
    out = None
    for fold in range(5):
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", standardization=False, regParam=1.0 / total, maxIter=50).fit(ready.where(F.col("fold") != fold))
        part = model.transform(ready.where(F.col("fold") == fold)).select("text_id", "fold", "y", _second("probability")[0].alias("gate_p"))
        out = part if out is None else out.unionByName(part)
    return out.select("text_id", "fold", F.col("y").cast("int").alias("severe"), r6("gate_p").alias("gate_p"))


def _second(vector: str):
    from pyspark.ml.functions import vector_to_array

    return F.slice(vector_to_array(vector), 2, 1)
