import numpy as np
import pytest
from pyspark.sql import functions as F

from rxweave.llm import consensus as C

SCHEMA = "item bigint, annotator string, label string, votes int, who int"


def votes(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)


def test_reads_labels(spark):
    cases = {"Moderate ": "Moderate", "mod.": "Moderate", " SEVERE": "Severe", "Sever": "Severe", "sev": "Severe", "Mld": "Mild", "mild.": "Mild", "m": None, "unsure": None, "?": None, "": None, None: None}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, w string")
    got = [r.x for r in df.select("k", C.read_label(F.col("w")).alias("x")).orderBy("k").collect()]
    assert got == list(cases.values())


def test_beats_the_majority_on_unequal_annotators(spark):
    rng = np.random.default_rng(1)
    skill = [0.95, 0.9, 0.85, 0.4, 0.4, 0.35, 0.4, 0.4]
    truth, rows = {}, []
    for item in range(600):
        truth[item] = int(rng.choice(3, p=[0.2, 0.55, 0.25]))
        for who in rng.choice(8, 5, replace=False):
            label = truth[item] if rng.random() < skill[who] else int(rng.choice([c for c in range(3) if c != truth[item]]))
            rows.append((item, f"ann_{who}", C.LABELS[label]))
    items, annotators = C.consensus(votes(spark, rows))
    right = np.mean([C.LABELS[truth[r.item]] == r.label for r in items.collect()])
    counts = {}
    for item, _, label in rows:
        counts.setdefault(item, []).append(label)
    majority = np.mean([max(C.LABELS, key=v.count) == C.LABELS[truth[i]] for i, v in counts.items()])
    assert right > majority + 0.04
    found = {r.annotator: r.reliability for r in annotators.collect()}
    assert min(found[f"ann_{k}"] for k in range(3)) > max(found[f"ann_{k}"] for k in range(3, 8))


def test_nulls_ties_and_items_without_votes(spark):
    rows = [(1, "a", "Mild"), (1, "b", "Mild"), (2, "a", None), (3, None, "Severe"), (None, "a", "Mild"), (4, "a", "odd"), (5, "a", "Mild"), (5, "b", "Mild")]
    items, annotators = C.consensus(votes(spark, rows))
    assert {r.item: r.label for r in items.collect()} == {1: "Mild", 2: "Mild", 3: "Mild", 4: "Mild", 5: "Mild"}
    assert {r.item for r in items.collect() if r.confidence is None} == {2, 3, 4}
    assert sum(r.votes for r in annotators.collect()) == 4


def test_no_votes_at_all(spark):
    items, annotators = C.consensus(votes(spark, [(1, "a", None)]))
    assert [tuple(r) for r in items.collect()] == [(1, "Mild", None)] and annotators.count() == 0
    items, annotators = C.consensus(spark.createDataFrame([], SCHEMA))
    assert items.count() == 0 and annotators.count() == 0


def test_an_item_with_a_third_of_all_votes(spark):
    rows = [(1, f"ann_{k % 9}", "Severe") for k in range(900)] + [(2 + k, f"ann_{k % 9}", "Mild") for k in range(1800)]
    got = {r.item: r.label for r in C.consensus(votes(spark, rows))[0].collect()}
    assert got[1] == "Severe" and got[2] == "Mild" and len(got) == 1801


def test_objective_rises_and_converges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"ann_{w}", C.LABELS[int(rng.integers(3)) if rng.random() < 0.3 else i % 3]) for i in range(150) for w in rng.choice(7, 4, replace=False)]
    made = C.fit(votes(spark, rows), tolerance=1e-4)
    assert made.converged and len(made.objective) > 2
    assert all(b >= a - 1e-9 for a, b in zip(made.objective, made.objective[1:]))
    cut = C.fit(votes(spark, rows), rounds=2)
    assert not cut.converged and len(cut.objective) == 1


def test_damped_steps_never_lower_the_dual():
    rng = np.random.default_rng(0)
    counts, tilt = rng.integers(0, 40, (500, 3)).astype(float), rng.normal(0, 3, (500, 3))
    value = lambda t: (counts * C._log_chance(t)).sum(1) - 0.5 * (t**2).sum(1)
    for _ in range(20):
        p = np.exp(C._log_chance(tilt))
        slope = counts - counts.sum(1, keepdims=True) * p - tilt
        bend = counts.sum(1)[:, None, None] * (p[..., None] * np.eye(3) - p[..., None] * p[:, None, :]) + np.eye(3)
        new = tilt + C.damped_step(slope, bend)
        assert (value(new) >= value(tilt) - 1e-9).all()
        tilt = new
    assert np.abs(slope).max() < 1e-3


def test_item_tilts_help_with_misleading_items(spark):
    """Every fifth item pulls all annotators to one and the same wrong label; the two good ones resist, the many weak ones don't."""
    rng = np.random.default_rng(3)
    truth, rows = {}, []
    for item in range(300):
        truth[item] = int(rng.integers(3))
        pull = np.zeros(3)
        pull[(truth[item] + 1) % 3] = 2.2 if item % 5 == 0 else 0
        for who in range(14):
            own = np.zeros(3)
            own[truth[item]] = 4.5 if who < 2 else 1.2
            chance = np.exp(own + pull)
            rows.append((item, f"ann_{who}", C.LABELS[int(rng.choice(3, p=chance / chance.sum()))]))
    score = {p: np.mean([C.LABELS[truth[r.item]] == r.label for r in C.consensus(votes(spark, rows), item_penalty=p, tolerance=1e-3)[0].collect()]) for p in (3.0, 1e9)}
    assert score[3.0] > score[1e9] + 0.05


def test_annotators_in_a_table_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, f"ann_{w}", C.LABELS[(i + int(rng.random() < 0.3)) % 3]) for i in range(60) for w in rng.choice(5, 3, replace=False)]
    want = {r.item: (r.label, pytest.approx(r.confidence, abs=1e-6)) for r in C.consensus(votes(spark, rows), rounds=4)[0].collect()}
    monkeypatch.setattr(C, "MOST_ANNOTATORS", 2)
    items, annotators = C.consensus(votes(spark, rows), rounds=4)
    assert {r.item: (r.label, r.confidence) for r in items.collect()} == want
    assert sum(r.votes for r in annotators.collect()) == len(rows)


def test_agreement(spark):
    rows = [(1, "a", "Mild"), (1, "b", "Mild"), (2, "a", "Mild"), (2, "b", "Severe"), (3, "a", "Severe"), (4, "a", None), (4, "b", "Mild")]
    r = C.agreement(votes(spark, rows)).first()
    assert (r.items, r.votes, r.agreeing_share) == (2, 4, 0.5)
    expected = (3 * 2 + 1 * 0) / (4 * 3)
    assert r.alpha == pytest.approx((0.5 - expected) / (1 - expected))
    empty = C.agreement(spark.createDataFrame([], SCHEMA)).first()
    assert empty["items"] == 0 and empty.alpha is None
