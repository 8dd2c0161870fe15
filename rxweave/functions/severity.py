"""Severity labels, rule cascades, gate features and gate decisions as JVM column expressions.

Every function takes and returns columns. Nulls: a null label normalises to ``No Interaction`` (strict: null); a null
description counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels with rank, class index and serious-risk score.
NO_INTERACTION = "No Interaction"
LABELS = ("Mild", "Moderate", "Severe")
OUTCOMES = (NO_INTERACTION, *LABELS)
RISK = {"No Interaction": 0.05, "Mild": 0.25, "Moderate": 0.75, "Severe": 0.95}

# Keywords of a description, tried in the order Severe, Moderate, Mild.
SEVERE_WORDS = (
    "contraindicated", "life-threatening", "fatal", "death", "deaths", "severe bleeding", "serious adverse", "do not use",
    "avoid use", "serious harm", "toxicity", "toxic", "cardiac arrest", "respiratory failure", "anaphylaxis",
    "severe hypotension", "coma", "seizures", "major", "significant", "requires immediate", "avoid combination", "serious",
    "substantially", "marked increase",
)
MODERATE_WORDS = (
    "closely monitor", "reduces efficacy", "increases risk", "adjust dose", "dose adjustment", "important", "may increase",
    "may decrease", "caution",
)
MILD_WORDS = (
    "minor", "possible interaction", "may occur", "clinical significance unknown", "limited data", "unlikely",
    "small increase", "minimal", "slight",
)

# Cue patterns of the gate, case-insensitive.
CUES = {
    "qtc_torsades": r"qtc|torsad",
    "bleed": r"bleed\w*|hemorrhag\w*|hematemesis|melena|hemoptysis",
    "bleed_risk": r"bleed\w*.{0,30}risk|risk.{0,30}bleed\w*|hemorrhag\w*.{0,30}risk|risk.{0,30}hemorrhag\w*",
    "arrhythmia": r"arrhythmia|ventricular|cardiac arrest|fibrillation|bradycardia|tachycardia",
    "rhabdo": r"rhabdomyolysis|myopathy|myoglobinuria",
    "serotonin": r"serotonin syndrome",
    "renal_failure": r"renal failure|kidney failure|acute renal",
    "organ_tox": r"nephrotoxic|cardiotoxic|neurotoxic|hepatotoxic|ototoxic|pulmonary toxicity|liver damage|\btoxicity\b|\btoxic\b",
    "excretion": r"excretion",
    "serum": r"serum level|serum concentration",
    "gi_only": r"gastrointestinal irritation|gastric irritation",
    "severe_event": r"neuromuscular block|paralysis|apnea|anaphylaxis|hypersensitivity|respiratory depress|respiratory failure|coma|seizure|convulsion|thrombosis|thromboembol|methemoglobinemia|angioedema",
}
# Patterns of descriptions that are mild by themselves, case-insensitive.
MILD_PATTERNS = (
    "gastrointestinal irritation",
    "may decrease the (sedative|hypertensive)",
    "hypertension can be decreased",
    r"therapeutic efficacy of (castor oil|sennosides|tadalafil|domperidone|dantron|beraprost|neosaxitoxin|magnesium)\b",
)

# The trained gate.
FEATURES = (
    "p_mild", "p_mod", "p_sev", "p_sev_minus_p_mod", "entropy", "n_words", "cue_qtc_torsades", "cue_bleed_event",
    "cue_bleed_risk", "cue_arrhythmia", "cue_rhabdo", "cue_serotonin", "cue_renal_failure", "cue_organ_tox",
    "cue_excretion_serum", "cue_gi_only", "cue_severe_event",
)
GATE_WEIGHTS = {
    "p_mild": -0.49509729001160074,
    "p_mod": -1.5975768234515975,
    "p_sev": 2.0652065068597056,
    "p_sev_minus_p_mod": 3.6627833303113,
    "entropy": 1.237977373569328,
    "n_words": 0.10340140488709659,
    "cue_qtc_torsades": 0.44817115070671804,
    "cue_bleed_event": 0.04903708133069136,
    "cue_bleed_risk": 0.2395174986149629,
    "cue_arrhythmia": -0.013974744057347789,
    "cue_rhabdo": 0.07858077653974944,
    "cue_serotonin": 0.04805329713929352,
    "cue_renal_failure": 0.06523513485991815,
    "cue_organ_tox": 0.12598324948545175,
    "cue_excretion_serum": -0.5179105520036644,
    "cue_gi_only": -0.4951337964609137,
    "cue_severe_event": 3.8191858751486283,
}
GATE_INTERCEPT = -1.686164234439873
GATE_THRESHOLD = 0.15
SEVERE_MIN_PROB, SEVERE_MARGIN = 0.50, 0.05


def cleaned(raw: Column) -> Column:
    """Upper case, letters and single spaces only; a null gives an empty string."""
    upper = F.upper(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "\n", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(upper, r"[^A-Z\s]", ""), r"\s+", " "))


def normalize(raw: Column, strict: bool = False) -> Column:
    text = cleaned(raw)
    known = F.when(text == "MILD", "Mild").when(text == "MODERATE", "Moderate").when(text.isin("SEVERE", "VERY SEVERE"), "Severe")
    return known if strict else known.otherwise(NO_INTERACTION)


def _by_label(label: Column, values: Mapping[str, float | int]) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(label == name, F.lit(value)) if out is None else out.when(label == name, F.lit(value))
    return out


def rank(raw: Column) -> Column:
    """0 for no interaction to 3 for Severe; also the class index."""
    return _by_label(normalize(raw), {name: k for k, name in enumerate(OUTCOMES)})


def risk_score(raw: Column) -> Column:
    return _by_label(normalize(raw), RISK)


def label_of_rank(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, OUTCOMES)), (number + 1).cast("int"))


def max_label(raw: Column) -> Column:
    """Aggregate: the highest label; no rows or only nulls give no interaction."""
    return label_of_rank(F.coalesce(F.max(rank(raw)), F.lit(0)))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(w.replace("-", r"\-") for w in words))


def keyword_severity(description: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.when(_any_of(low, SEVERE_WORDS), "Severe").when(_any_of(low, MODERATE_WORDS), "Moderate").when(_any_of(low, MILD_WORDS), "Mild").otherwise("Moderate")


def cue(description: Column, name: str) -> Column:
    return F.coalesce(description, F.lit("")).rlike(f"(?i){CUES[name]}")


def is_genuinely_mild(description: Column) -> Column:
    text = F.coalesce(description, F.lit(""))
    out = cue(description, "excretion") & ~cue(description, "serum")
    for pattern in MILD_PATTERNS:
        out = out | text.rlike(f"(?i){pattern}")
    return out


def clipped_probabilities(p: list[Column]) -> list[Column]:
    """Clipped to 1e-9..1 and scaled to a sum of one."""
    kept = [F.least(F.greatest(x, F.lit(1e-9)), F.lit(1.0)) for x in p]
    total = sum(kept[1:], kept[0])
    return [x / total for x in kept]


def entropy(p: list[Column]) -> Column:
    parts = [x * F.ln(x) for x in p]
    return -sum(parts[1:], parts[0])


def gate_features(description: Column, p_mild: Column, p_mod: Column, p_sev: Column) -> dict[str, Column]:
    """The gate's features by name, as doubles."""
    p = clipped_probabilities([p_mild, p_mod, p_sev])
    text = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    n_words = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    bleeds, risk = cue(description, "bleed"), cue(description, "bleed_risk")
    flags = {
        "cue_qtc_torsades": cue(description, "qtc_torsades"),
        "cue_bleed_event": bleeds & ~risk,
        "cue_bleed_risk": bleeds & risk,
        **{f"cue_{n}": cue(description, n) for n in ("arrhythmia", "rhabdo", "serotonin", "renal_failure", "organ_tox")},
        "cue_excretion_serum": cue(description, "excretion") & cue(description, "serum"),
        "cue_gi_only": cue(description, "gi_only"),
        "cue_severe_event": cue(description, "severe_event"),
    }
    numbers = {"p_mild": p[0], "p_mod": p[1], "p_sev": p[2], "p_sev_minus_p_mod": p[2] - p[1], "entropy": entropy(p), "n_words": n_words.cast("double")}
    return numbers | {name: flag.cast("double") for name, flag in flags.items()}


def logistic(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def linear(features: Mapping[str, Column], weights: Mapping[str, float] = GATE_WEIGHTS, intercept: float = GATE_INTERCEPT) -> Column:
    out = F.lit(intercept)
    for name, weight in weights.items():
        out = out + features[name] * weight
    return out


def gate_probability(description: Column, p_mild: Column, p_mod: Column, p_sev: Column) -> Column:
    return logistic(linear(gate_features(description, p_mild, p_mod, p_sev)))


def gated(label: Column, risk: Column, p_mod: Column, p_sev: Column, description: Column, mode: str = "regex", gate_p: Column | None = None) -> tuple[Column, Column]:
    """Severity and risk after the gate. ``mode``: ``none``, ``regex`` or ``learned`` (needs ``gate_p``); anything else is ``regex``.

    In every mode a Mild call without a mild description becomes Moderate with a risk of 0.75 at least.
    """
    mild_ok = is_genuinely_mild(description)
    if mode == "learned":
        if gate_p is None:
            raise ValueError("the learned gate needs gate_p")
        other = F.when(gate_p >= GATE_THRESHOLD, "Severe").otherwise("Moderate")
    elif mode == "none":
        other = label
    else:
        weak = (p_sev < SEVERE_MIN_PROB) | (p_sev - p_mod < SEVERE_MARGIN)
        other = F.when((label == "Severe") & weak, "Moderate").otherwise(label)
    severity = F.when((label == "Mild") & mild_ok, "Mild").when(label == "Mild", "Moderate").otherwise(other)
    score = F.when((label == "Mild") & ~mild_ok, F.greatest(risk, F.lit(RISK["Moderate"]))).otherwise(risk)
    return severity, score


def safety_first(database: Column, second: Column) -> Column:
    """The higher of two opinions; the database's where the second is null or no severity."""
    return F.when(normalize(second, strict=True).isNotNull() & (rank(second) > rank(database)), normalize(second)).otherwise(database)
