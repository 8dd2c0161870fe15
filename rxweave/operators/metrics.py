"""Evaluation metrics over label and score columns, each as one or two aggregations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import running_totals
from ..plans.session import literal_rows


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_frame(df: DataFrame, labels: tuple[str, ...], name: str) -> DataFrame:
    return literal_rows(df.sparkSession, **{name: list(labels)})


def confusion(rows: DataFrame, truth: str, found: str, labels: tuple[str, ...]) -> DataFrame:
    """``truth, found, n`` for all pairs of labels, zeros included; other labels and nulls are left out."""
    counted = rows.groupBy(F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count(F.lit(1)).alias("n"))
    grid = label_frame(rows, labels, "truth").select("truth").crossJoin(F.broadcast(label_frame(rows, labels, "found").select("found")))
    return grid.join(counted, ["truth", "found"], "left").select("truth", "found", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(rows: DataFrame, truth: str, found: str, labels: tuple[str, ...]) -> DataFrame:
    """``label, precision, recall, f1, support`` per label; what has no cases scores 0."""
    cells = confusion(rows, truth, found, labels)
    per = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p")), F.struct(F.col("found").alias("label"), F.lit(0).alias("t"), F.col("n").alias("p")))).alias("x"), F.when(F.col("truth") == F.col("found"), F.col("n")).otherwise(0).alias("hit"))
    agg = per.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), (F.sum("hit") / 2).alias("hits"))
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return agg.select("label", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), "support")


def summary(rows: DataFrame, truth: str, found: str, labels: tuple[str, ...]) -> DataFrame:
    """One row ``n, accuracy, macro_f1, weighted_f1``; the macro average is over labels that occur on either side."""
    cells = confusion(rows, truth, found, labels)
    per = class_report(rows, truth, found, labels)
    seen = cells.groupBy(F.col("found").alias("label")).agg(F.sum("n").alias("predicted"))
    scored = per.join(seen, "label").agg(
        F.avg(F.when((F.col("support") > 0) | (F.col("predicted") > 0), F.col("f1"))).alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")
    )
    right = cells.agg(F.sum("n").alias("n"), ratio(F.sum(F.when(F.col("truth") == F.col("found"), F.col("n"))), F.sum("n")).alias("accuracy"))
    return right.crossJoin(scored)


def binary(rows: DataFrame, positive: Column, called: Column) -> DataFrame:
    """One row ``tp, fp, fn, tn, sensitivity, specificity, precision, f1``; rows with a null on either side are left out."""
    t, c = positive, called
    agg = rows.where(t.isNotNull() & c.isNotNull()).agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & ~c).alias("tn"))
    sens, prec = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return agg.select("tp", "fp", "fn", "tn", sens.alias("sensitivity"), ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), prec.alias("precision"), ratio(2 * prec * sens, prec + sens).alias("f1"))


def score_counts(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """Positives and negatives per distinct score: what curves need, however many rows there are."""
    return rows.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def roc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """``threshold, tp, fp, tpr, fpr`` for every distinct score; rows are brought to one per score first."""
    counts = score_counts(rows, score, positive)
    total = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    run = running_totals(counts, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    return run.crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), "tp", "fp", ratio(F.col("tp"), F.col("P")).alias("tpr"), ratio(F.col("fp"), F.col("N")).alias("fpr"))


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row ``auc``: the chance that a positive outscores a negative, ties half; 0.5 with one class only."""
    counts = score_counts(rows, score, positive)
    below = running_totals(counts, "score", {"below": "neg"}, inclusive=False)
    agg = below.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(F.coalesce(F.try_divide("wins", (F.col("P") * F.col("N")).cast("double")), F.lit(0.5)).alias("auc"))


def net_benefit(rows: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """``threshold, n, tp, fp, net_benefit`` of acting on scores at or above each threshold."""
    grid = literal_rows(rows.sparkSession, threshold=thresholds)
    counts = score_counts(rows, score, positive).crossJoin(F.broadcast(grid))
    above = F.col("score") >= F.col("threshold")
    agg = counts.groupBy("threshold").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"))
    t = F.col("threshold")
    return agg.select("threshold", "n", "tp", "fp", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * t / (1 - t)).alias("net_benefit"))


def calibration(rows: DataFrame, score: str, positive: Column, bins: int = 10) -> DataFrame:
    """``bin, n, mean_score, positive_share`` over equal bins of 0..1; empty bins are left out."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    kept = rows.where(F.col(score).isNotNull() & positive.isNotNull())
    return kept.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(positive.cast("double")).alias("positive_share"))


def describe(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, extremes, ``confidence = 1 - min(std, 1)`` and exact percentile intervals (95, 99 %)."""
    v = F.col(value)
    agg = rows.groupBy(*(keys or [])).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, F.array(*map(F.lit, (0.025, 0.975, 0.005, 0.995)))).alias("p"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return agg.select(
        *(keys or []), "n", zero(F.col("mean")).alias("mean"), zero(F.col("std")).alias("std"), zero(F.col("min")).alias("min"), zero(F.col("max")).alias("max"),
        (1 - F.least(zero(F.col("std")), F.lit(1.0))).alias("confidence"),
        *(F.col("p")[k].alias(n) for k, n in enumerate(("ci95_low", "ci95_high", "ci99_low", "ci99_high"))),
    )


def _resampled(cells: DataFrame, columns: list[str], draws: int, seed: int, statistics: Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """``metric, mean, low, high, above`` over ``draws`` bootstrap samples; ``above`` is the share of draws above 0.

    Resampling n rows with replacement gives every cell of equal rows a multinomial count, so samples are drawn from the
    cells' counts ``n`` and no row is ever repeated. Cells are few: one for every combination of labels.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(columns, ignore_index=True)
        total = int(pdf["n"].sum())
        drawn = np.random.default_rng(seed).multinomial(total, pdf["n"].to_numpy(float) / total, draws)
        made = statistics(pdf, drawn)
        return pd.DataFrame([(k, v.mean(), *np.percentile(v, [2.5, 97.5]), (v > 0).mean()) for k, v in made.items()], columns=["metric", "mean", "low", "high", "above"])

    return cells.groupBy().applyInPandas(run, "metric string, mean double, low double, high double, above double")


def bootstrap(rows: DataFrame, value: Column, draws: int, seed: int) -> DataFrame:
    """``mean, low, high, above`` of the mean of ``value``, which has few different values, over bootstrap samples of the
    rows. Nulls don't count; without rows there is no result."""
    cells = rows.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return _resampled(cells, ["v"], draws, seed, lambda pdf, drawn: {"mean": drawn @ pdf["v"].to_numpy() / drawn.sum(1)}).drop("metric")


def bootstrap_classes(rows: DataFrame, truth: str, found: str, positive: list[str], draws: int, seed: int) -> DataFrame:
    """``metric, mean, low, high`` of ``accuracy``, ``macro_f1`` over the labels of the truth or the finding, and
    ``binary_f1`` of ``positive`` labels against the others. Rows with a null on either side don't count."""
    cells = rows.select(F.col(truth).alias("t"), F.col(found).alias("f")).dropna().groupBy("t", "f").agg(F.count(F.lit(1)).alias("n"))

    def f1(drawn: np.ndarray, t: np.ndarray, f: np.ndarray) -> np.ndarray:
        return 2 * drawn[:, t & f].sum(1) / np.maximum(1, drawn[:, t].sum(1) + drawn[:, f].sum(1))

    def statistics(pdf: pd.DataFrame, drawn: np.ndarray) -> dict[str, np.ndarray]:
        t, f = pdf["t"].to_numpy(), pdf["f"].to_numpy()
        labels = sorted(set(t) | set(f))
        macro = np.mean([f1(drawn, t == x, f == x) for x in labels], 0)
        return {"accuracy": drawn[:, t == f].sum(1) / drawn.sum(1), "macro_f1": macro, "binary_f1": f1(drawn, np.isin(t, positive), np.isin(f, positive))}

    return _resampled(cells, ["t", "f"], draws, seed, statistics).drop("above")
