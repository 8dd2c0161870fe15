"""Published figures of two 233-row evaluations, recomputed from their confusion matrices."""

import pytest
from pyspark.sql import functions as F

from rxweave.functions import severity as S
from rxweave.operators import metrics as M

# Confusion matrices (rows are the truth, in the order of S.OUTCOMES) and the figures published for them.
RUNS = {
    "ensemble": ([[31, 0, 1, 0], [0, 2, 0, 0], [0, 0, 128, 6], [0, 0, 8, 57]], 0.9356, 0.9549, 1.0, 0.9706, 0.9975),
    "keyword": ([[31, 0, 1, 0], [0, 0, 2, 0], [0, 0, 122, 12], [0, 0, 8, 57]], 0.9013, 0.6872, 1.0, 0.9118, 0.9925),
}


@pytest.fixture(params=RUNS)
def run(request, spark):
    cells, *figures = RUNS[request.param]
    rows = [(S.OUTCOMES[t], S.OUTCOMES[p]) for t in range(4) for p in range(4) for _ in range(cells[t][p])]
    return spark.createDataFrame(rows, "truth string, found string"), cells, figures


def test_confusion(run):
    rows, cells, _ = run
    got = {(r.truth, r.found): r.n for r in M.confusion(rows, "truth", "found", S.OUTCOMES).collect()}
    assert got == {(S.OUTCOMES[t], S.OUTCOMES[p]): cells[t][p] for t in range(4) for p in range(4)}


def test_accuracy_and_macro_f1(run):
    rows, _, figures = run
    s = M.summary(rows, "truth", "found", S.OUTCOMES).first()
    assert s.n == 233 and s.accuracy == pytest.approx(figures[0], abs=5e-5) and s.macro_f1 == pytest.approx(figures[1], abs=5e-5)


def test_binary(run):
    rows, _, figures = run
    b = M.binary(rows, S.rank(F.col("truth")) >= 2, S.rank(F.col("found")) >= 2).first()
    assert (b.sensitivity, b.specificity, b.f1) == tuple(pytest.approx(x, abs=5e-5) for x in figures[2:])


def test_pair_scores_of_published_counts(spark):
    """240 of 250 found pairs are among the 243 true ones, 224 of them with the same severity."""
    rows = [("tp", True)] * 224 + [("tp", False)] * 16 + [("fp", None)] * 10 + [("fn", None)] * 3
    df = spark.createDataFrame(rows, "outcome string, severity_agrees boolean")
    n = {o: df.where(F.col("outcome") == o).count() for o in ("tp", "fp", "fn")}
    got = df.select(F.lit(n["tp"]).alias("tp")).limit(1).select(M.ratio(F.col("tp"), F.lit(n["tp"] + n["fp"])).alias("p"), M.ratio(F.col("tp"), F.lit(n["tp"] + n["fn"])).alias("r")).first()
    assert got.p == pytest.approx(0.96) and got.r == pytest.approx(0.9877, abs=5e-5)
