import difflib
import math

import pytest
from pyspark.sql import functions as F

from rxweave.functions import severity as S
from rxweave.functions import similarity, vectors
from rxweave.functions import text as T
from rxweave.functions.words import word_hashes, words


def values(spark, f, inputs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


CASES = [
    (T.clean_mention, {"Dolo 650 twice daily": "dolo", "Starpress XL 25mg TAB": "starpress", "amox/clav": "amox/clav", "": "", None: None}),
    (T.glued_presplit, {"simvastatin20mg": "simvastatin 20mg", "500mgBD": "500mg BD", None: None}),
    (T.collapse_token, {"starpress xl": "starpress", "dolo-650": "dolo", "telma-h": "telma-h", "xl": "xl", None: None}),
    (T.prettify, {"telma-h": "Telma-H", "dolo": "Dolo", None: None}),
    (T.title_case, {"ramistar-AM 5mg": "Ramistar-Am 5Mg", None: None}),
    (T.brand_token, {"Augmentin 625 Duo Tablet": "augmentin duo", "Telma-H 40/12.5": "telma-h", None: None}),
    (T.valid_entity, {"Dolo": True, "mg": False, "before meals": False, "12": False, "x": False, "": False, None: False}),
    (T.entity_tag, {"B-DRUG": "MEDICATION", "i-chem": "MEDICATION", "DOSE": "DOSAGE", "": "UNKNOWN", "LAB": "LAB"}),
    (T.clean_entity_text, {" ##pan_d ,.": "pan d", None: None}),
    (T.retry_delay, {"retryDelay: '7.5s'": 7.5, "Please retry in 0.01s": 0.2, "": 2.0, None: 2.0}),
    (T.strip_fences, {'```json\n{"a": 1}\n```': '{"a": 1}', "plain": "plain"}),
    (S.normalize, {"severe ": "Severe", "VERY  SEVERE": "Severe", "Mild.": "Mild", "odd": "No Interaction", None: "No Interaction"}),
    (S.rank, {"Severe": 3, "mild": 1, None: 0}),
    (S.keyword_severity, {"It is fatal": "Severe", "use caution": "Moderate", "a minor effect": "Mild", "nothing": "Moderate", None: "Moderate"}),
    (S.is_genuinely_mild, {"may increase the excretion rate": True, "excretion and serum level change": False, "gastrointestinal irritation": True, None: False}),
]


@pytest.mark.parametrize("f, cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_values(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_strict_normalize_gives_null(spark):
    assert values(spark, lambda c: S.normalize(c, strict=True), ["odd", None, "Moderate"]) == [None, None, "Moderate"]


def test_gate_probability_matches_the_formula(spark):
    df = spark.createDataFrame([("coma and seizures", 0.1, 0.3, 0.6)], "d string, a double, b double, c double")
    got = df.select(S.gate_probability(F.col("d"), F.col("a"), F.col("b"), F.col("c")).alias("p")).first().p
    entropy = -sum(p * math.log(p) for p in (0.1, 0.3, 0.6))
    w = S.GATE_WEIGHTS
    z = S.GATE_INTERCEPT + 0.1 * w["p_mild"] + 0.3 * w["p_mod"] + 0.6 * w["p_sev"] + 0.3 * w["p_sev_minus_p_mod"] + entropy * w["entropy"] + 3 * w["n_words"] + w["cue_severe_event"]
    assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_gate_modes(spark):
    df = spark.createDataFrame([("Mild", 0.2, 0.3, 0.1, "x"), ("Severe", 0.9, 0.45, 0.48, "x"), ("Severe", 0.9, 0.1, 0.8, "x"), ("Moderate", 0.6, 0.6, 0.2, "x")], "l string, r double, m double, s double, d string")

    def run(mode, gate=None):
        label, risk = S.gated(F.col("l"), F.col("r"), F.col("m"), F.col("s"), F.col("d"), mode, gate)
        return [(r.a, r.b) for r in df.select(label.alias("a"), risk.alias("b")).collect()]

    assert run("none") == [("Moderate", 0.75), ("Severe", 0.9), ("Severe", 0.9), ("Moderate", 0.6)]
    assert run("regex") == run("anything") == [("Moderate", 0.75), ("Moderate", 0.9), ("Severe", 0.9), ("Moderate", 0.6)]
    assert run("learned", F.lit(0.2)) == [("Moderate", 0.75), ("Severe", 0.9), ("Severe", 0.9), ("Severe", 0.6)]


def test_safety_first(spark):
    df = spark.createDataFrame([("Mild", "Severe"), ("Severe", "Mild"), ("Mild", None), ("Mild", "N/A")], "a string, b string")
    assert [r.x for r in df.select(S.safety_first(F.col("a"), F.col("b")).alias("x")).collect()] == ["Severe", "Severe", "Mild", "Mild"]


def test_similarities(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("abcd", "abxd"), (None, "a"), ("", "")], "a string, b string")
    got = df.select(similarity.gestalt("a", "b").alias("g"), similarity.indel_ratio("a", "b").alias("i")).collect()
    assert [r.g for r in got][:2] == [0.25, 0.5]
    assert got[2].g == difflib.SequenceMatcher(None, "abcd", "abxd").ratio()
    assert got[2].i == 75.0 and got[3].g is None and got[4].i == 100.0
    assert similarity.weighted_ratio("acid folic", "folic acid") == 95.0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] is None


def test_words(spark):
    assert values(spark, words, ["Ab-1, ÉÀ_x", "", " -- ", None]) == [["ab", "1", "éà", "x"], [], [], None]
    assert [len(x) for x in values(spark, word_hashes, ["b a b", "", None])] == [2, 0, 0]
