"""Consensus labels by regularised minimax conditional entropy.

The chance that annotator j gives item i the label k when its true label is c is taken as proportional to
``exp(s_j[c, k] + t_i[c, k])``: one tilting matrix per annotator and one per item, the dual variables of the minimax
problem, both with a quadratic penalty. With the label posteriors Q the regularised dual objective is

    sum over items of [ Q log-chance of the votes + entropy of Q - item_penalty/2 |t_i|^2 ]
    - annotator_penalty/2 sum over annotators of |s_j|^2

It is climbed block by block, in turn over the posteriors (their maximum), the rows of every item's matrix, the posteriors
again, and the rows of every annotator's matrix. Given the others the rows are independent and
concave; each takes a Newton step, damped so that it never falls. So the objective rises from round to round, and is
reported. The items' matrices live in a table with their votes and are carried from round to round; annotators' matrices
are broadcast up to a bound, and beyond it joined to the votes.

Labels are taken to be equally frequent, as the method has it; ``label_shares`` lets their estimated shares count, an
addition for labels of very unequal frequency.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import discard, materialised

LABELS = ("Mild", "Moderate", "Severe")
#: Annotators up to which their matrices are broadcast; beyond it they are joined to the votes in every round.
MOST_ANNOTATORS = 50_000
#: A softmax of unit features is self-concordant with this constant: a Newton step of length d, cut to ln(1 + Md) / Md,
#: never lowers the objective.
CONCORDANCE = 6**0.5


def read_label(written: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label meant by a free spelling, or null: case and signs are disregarded; a beginning that fits one label
    only, or else a spelling within two edits of one label and farther from all others, counts as that label."""
    letters = F.regexp_replace(F.lower(written), r"[^\p{L}]", "")
    known = F.array(*(F.struct(F.lit(x.lower()).alias("name"), F.lit(x).alias("label")) for x in labels))

    def apart(letters: Column) -> Column:
        begins = lambda n: n.startswith(letters) | letters.startswith(n)
        edits = lambda n: F.when(F.length(letters) >= 3, F.levenshtein(letters, n)).otherwise(99)
        return F.array_sort(F.transform(known, lambda x: F.struct(F.when(begins(x["name"]), 0).otherwise(edits(x["name"])).alias("d"), x["label"].alias("label"))))

    # a one-element transform binds the letters, and then the ranking, to a name: each is computed once
    ranked = F.transform(F.array(letters), apart)
    chosen = F.transform(ranked, lambda r: F.when((r[0]["d"] <= 2) & (r[0]["d"] < r[1]["d"]), r[0]["label"]))
    return F.when(letters != "", chosen[0])


def _log_chance(logits: np.ndarray) -> np.ndarray:
    top = logits.max(-1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(-1, keepdims=True))


def damped_step(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """Damped Newton steps for many rows at once: slopes (..., k) and negated Hessians (..., k, k), penalties included."""
    step = np.linalg.solve(bend, slope[..., None])[..., 0]
    far = CONCORDANCE * np.linalg.norm(step, axis=-1, keepdims=True)
    return step * np.where(far > 1e-9, np.log1p(far) / np.maximum(far, 1e-9), 1.0)


@dataclass
class Votes:
    """The votes of a batch of items, those of an item one after the other."""

    starts: np.ndarray
    item: np.ndarray
    who: np.ndarray
    given: np.ndarray
    times: np.ndarray
    tilt: np.ndarray | None  # the annotators' matrices, vote by vote; None before the first round

    def per_item(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0)


def posteriors(v: Votes, tilt: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The posteriors that maximise the objective, what the items add to it without penalties, and all chances."""
    logs = _log_chance(v.tilt + tilt[v.item])
    taken = np.take_along_axis(logs, v.given[:, None, None].repeat(logs.shape[1], 1), 2)[:, :, 0]
    fit = np.log(np.maximum(shares, 1e-9)) + v.per_item(v.times[:, None] * taken)
    top = fit.max(1, keepdims=True)
    whole = top + np.log(np.exp(fit - top).sum(1, keepdims=True))
    return np.exp(fit - whole), whole[:, 0], np.exp(logs)


def _slopes(v: Votes, weight: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vote by vote, slope (c, k) and negated Hessian (c, k, k) of the weighted log-chance."""
    labels = chance.shape[-1]
    slope = weight[:, :, None] * (np.eye(labels)[v.given][:, None, :] - chance)
    bend = weight[:, :, None, None] * (chance[..., None] * np.eye(labels) - chance[..., None] * chance[..., None, :])
    return slope, bend


def climb_items(v: Votes, tilt: np.ndarray, shares: np.ndarray, penalty: float, turns: int) -> np.ndarray:
    """The items' matrices after ``turns`` damped Newton steps of every row, each with the posteriors' maximum before."""
    for _ in range(turns):
        posterior, _, chance = posteriors(v, tilt, shares)
        slope, bend = _slopes(v, posterior[v.item] * v.times[:, None], chance)
        tilt = tilt + damped_step(v.per_item(slope) - penalty * tilt, v.per_item(bend) + penalty * np.eye(tilt.shape[-1]))
    return tilt


def _read(batch: pa.RecordBatch, model) -> tuple[Votes, np.ndarray]:
    lists = batch.column("votes")
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    rows = lists.flatten()
    sizes = np.diff(np.append(starts, len(rows)))
    who, given, times = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    tilts = batch.column("tilt").flatten().to_numpy().reshape(batch.num_rows, -1)
    labels = int(round(tilts.shape[1] ** 0.5))
    if rows.type.num_fields > 3:
        own = rows.field(3).flatten().to_numpy().reshape(-1, labels, labels)
    else:
        own = None if model is None else model[who]
    return Votes(starts, np.repeat(np.arange(batch.num_rows), sizes), who, given.astype(np.int64), times.astype(np.float64), own), tilts.reshape(-1, labels, labels)


def _round(shared, shares: np.ndarray | None, penalty: float, turns: int):
    """One pass: the items' new matrices, and what the annotators' steps need, added up by task in extra rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        whole, seen, types = 0.0, 0.0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, tilt = _read(batch, shared.value if shared else None)
            labels = tilt.shape[-1]
            if v.tilt is None:  # first round: the shares of the votes stand in for posteriors
                count = np.zeros((batch.num_rows, labels))
                np.add.at(count, (v.item, v.given), v.times)
                posterior, chance = count / count.sum(1, keepdims=True), np.full((len(v.item), labels, labels), 1.0 / labels)
            else:
                tilt = climb_items(v, tilt, shares, penalty, turns)
                posterior, gain, chance = posteriors(v, tilt, shares)
                whole += gain.sum() - penalty / 2 * (tilt**2).sum()
            slope, bend = _slopes(v, posterior[v.item] * v.times[:, None], chance)
            parts = np.concatenate([slope.reshape(len(v.who), -1), bend.reshape(len(v.who), -1), (v.times * posterior[v.item, v.given])[:, None], v.times[:, None]], 1)
            order = np.argsort(v.who, kind="stable")
            ids, first = np.unique(v.who[order], return_index=True)
            for who, sums in zip(ids.tolist(), np.add.reduceat(parts[order], first, axis=0)):
                totals[who] = totals.get(who, 0.0) + sums
            seen = seen + posterior.sum(0)
            types = batch.schema
            offsets = pa.array(np.arange(0, tilt.size + 1, labels * labels, dtype=np.int32))
            none = pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), _bare(batch.column("votes")), pa.ListArray.from_arrays(offsets, pa.array(tilt.ravel())), *none], names=["item", "votes", "tilt", "who", "x"])
        if types is not None:
            totals[-1] = np.concatenate([[whole], seen])
            n = len(totals)
            votes = pa.nulls(n, VOTES)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, types.field("item").type), votes, pa.nulls(n, pa.list_(pa.float64())), pa.array(list(totals), pa.int64()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))],
                names=["item", "votes", "tilt", "who", "x"],
            )

    return run


VOTES = pa.list_(pa.struct([("who", pa.int64()), ("given", pa.int32()), ("times", pa.float64())]))


def _bare(votes: pa.Array) -> pa.Array:
    """The votes without the annotators' matrices."""
    rows = votes.flatten()
    offsets = pa.array(votes.offsets.to_numpy() - votes.offsets[0].as_py())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([rows.field(k) for k in range(3)], fields=list(VOTES.value_type)))


def _labelled(shared, shares: np.ndarray, labels: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, tilt = _read(batch, shared.value if shared else None)
            posterior = posteriors(v, tilt, shares)[0]
            best = posterior.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array([labels[k] for k in best], pa.string()), pa.array(posterior.max(1))], names=["item", "label", "confidence"]
            )

    return run


def _stepped(labels: int, penalty: float):
    """The annotators' damped Newton steps: ``who, tilt, right, times, size, step`` from ``who, x, tilt``."""
    cells = labels * labels

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x, tilt = np.array(pdf["x"].tolist()), np.array(pdf["tilt"].tolist()).reshape(-1, labels, labels)
            slope, bend = x[:, :cells].reshape(-1, labels, labels), x[:, cells : cells + cells * labels].reshape(-1, labels, labels, labels)
            step = damped_step(slope - penalty * tilt, bend + penalty * np.eye(labels))
            new = tilt + step
            yield pd.DataFrame({"who": pdf["who"], "tilt": list(new.reshape(-1, cells)), "right": x[:, -2], "times": x[:, -1], "size": (new**2).sum((1, 2)), "step": np.abs(step).max((1, 2))})

    return run


@dataclass
class Fit:
    labels: tuple[str, ...]
    names: DataFrame | None = None  # annotator, who
    annotators: DataFrame | None = None  # who, tilt, right, times
    state: DataFrame | None = None  # item, votes, tilt
    shares: np.ndarray | None = None  # of the labels, by the posteriors
    prior: np.ndarray | None = None  # what counts in the posteriors
    objective: list[float] = field(default_factory=list)  # after every round
    converged: bool = False


def _with_matrices(state: DataFrame, annotators: DataFrame | None, number: int):
    """The votes as the passes want them, and the broadcast matrices if they are few enough."""
    if annotators is None:
        return state, None
    if number <= MOST_ANNOTATORS:
        rows = annotators.select("who", "tilt").toPandas().sort_values("who")
        flat = np.array(rows["tilt"].tolist())
        labels = int(round(flat.shape[1] ** 0.5))
        return state, state.sparkSession.sparkContext.broadcast(flat.reshape(-1, labels, labels))
    each = state.select("item", "tilt", F.explode("votes").alias("v")).select("item", "tilt", "v.who", "v.given", "v.times")
    joined = each.join(annotators.select("who", F.col("tilt").alias("own")), "who")
    return joined.groupBy("item").agg(F.collect_list(F.struct("who", "given", "times", F.col("own").alias("tilt"))).alias("votes"), F.any_value("tilt").alias("tilt")), None


def fit(votes: DataFrame, labels: tuple[str, ...] = LABELS, rounds: int = 40, annotator_penalty: float = 1.0, item_penalty: float = 10.0, turns: int = 2, tolerance: float = 1e-5, label_shares: bool = False) -> Fit:
    """Climbs the dual until a round gains less than ``tolerance`` per vote, for ``rounds`` rounds at most; see ``consensus``."""
    c = len(labels)
    code = F.coalesce(*(F.when(F.col("label") == x, F.lit(k)) for k, x in enumerate(labels)))
    valid = votes.select("item", "annotator", code.alias("given")).where("item is not null and given is not null and annotator is not null")
    counted = materialised(valid.groupBy("item", "annotator", "given").agg(F.count(F.lit(1)).cast("double").alias("times")))
    names = counted.select("annotator").distinct()
    number = names.count()
    out = Fit(labels)
    if not number:
        return out
    if number <= MOST_ANNOTATORS:
        listed = names.toPandas()["annotator"].sort_values(ignore_index=True)
        names = F.broadcast(votes.sparkSession.createDataFrame(list(zip(listed.tolist(), range(number))), f"annotator {dict(counted.dtypes)['annotator']}, who bigint"))
    else:
        names = materialised(names.select("annotator", F.monotonically_increasing_id().alias("who")))
    out.names = names
    vote = F.struct("who", F.col("given").cast("int").alias("given"), "times")
    zeros = F.array(*[F.lit(0.0)] * (c * c))
    out.state = materialised(counted.join(names, "annotator").groupBy("item").agg(F.collect_list(vote).alias("votes")).select("item", "votes", zeros.alias("tilt")))
    total = counted.agg(F.sum("times")).first()[0]
    item_type = dict(out.state.dtypes)["item"]
    schema = f"item {item_type}, votes array<struct<who: bigint, given: int, times: double>>, tilt array<double>, who bigint, x array<double>"
    width = c * c + c * c * c + 2
    last = out.state
    for _ in range(rounds):
        votes_with, shared = _with_matrices(out.state, out.annotators, number)
        made = materialised(votes_with.mapInArrow(_round(shared, out.prior, item_penalty, turns), schema))
        discard(last)  # the matrices of the round before
        last = made
        state = made.where("who is null").select("item", "votes", "tilt")
        sums = made.where("who is not null").groupBy("who").agg(F.array(*(F.sum(F.try_element_at("x", F.lit(k + 1))) for k in range(width))).alias("x"))
        whole = sums.where("who = -1").first()["x"]
        sizes = 0.0 if out.annotators is None else out.annotators.agg(F.sum("size")).first()[0]
        started = out.annotators is not None
        if started:
            out.objective.append(whole[0] - annotator_penalty / 2 * sizes)
        out.state, out.shares = state, np.array(whole[1 : 1 + c]) / sum(whole[1 : 1 + c])
        out.prior = out.shares if label_shares else np.full(c, 1.0 / c)
        if len(out.objective) > 1 and out.objective[-1] - out.objective[-2] < tolerance * total:
            out.converged = True
            break
        before = sums.where("who >= 0").withColumn("tilt", zeros) if not started else sums.where("who >= 0").join(out.annotators.select("who", "tilt"), "who")
        moved = before.select("who", "x", "tilt").mapInPandas(_stepped(c, annotator_penalty), "who bigint, tilt array<double>, right double, times double, size double, step double")
        out.annotators = materialised(moved)
    return out


def consensus(votes: DataFrame, labels: tuple[str, ...] = LABELS, **params) -> tuple[DataFrame, DataFrame]:
    """``votes``: one row per vote with ``item``, ``annotator``, ``label``; extra columns are ignored.

    Returns ``items(item, label, confidence)``, one row for every item that occurs, and
    ``annotators(annotator, votes, reliability)``, the reliability being the mean posterior of the labels given.
    ``params``: those of ``fit``.

    A null label, or one outside ``labels``, or a null annotator is no vote. An item without any vote gets the label
    with the largest share over all items and confidence null; a null item is dropped. Ties go to the earlier label.
    Repeated votes of one annotator on one item add up; drop repeated rows beforehand. An empty table gives empty
    results. An item with very many votes is held as one count per annotator and label.
    """
    return labelled(votes, fit(votes, labels, **params))


def labelled(votes: DataFrame, made: Fit) -> tuple[DataFrame, DataFrame]:
    """Items and annotators of a fit to these votes."""
    every = votes.select("item").where("item is not null").distinct()
    if made.names is None:
        none = votes.sparkSession.createDataFrame([], "annotator string, votes bigint, reliability double")
        return every.select("item", F.lit(made.labels[0]).alias("label"), F.lit(None).cast("double").alias("confidence")), none
    votes_with, shared = _with_matrices(made.state, made.annotators, made.annotators.count())
    best = votes_with.mapInArrow(_labelled(shared, made.prior, made.labels), f"item {dict(made.state.dtypes)['item']}, label string, confidence double")
    common = made.labels[int(made.shares.argmax())]
    items = every.join(best, "item", "left").select("item", F.coalesce("label", F.lit(common)).alias("label"), "confidence")
    annotators = made.annotators.join(made.names, "who").select("annotator", F.col("times").cast("bigint").alias("votes"), (F.col("right") / F.col("times")).alias("reliability"))
    return items, annotators


def agreement(votes: DataFrame) -> DataFrame:
    """One row: ``items, votes, agreeing_share, alpha`` over the items with at least two votes.

    ``agreeing_share`` is the share of agreeing pairs of votes, each item weighing as its votes less one in
    Krippendorff's alpha for nominal labels. Null items and labels are no votes. Without such items both are null.
    """
    per = votes.where("item is not null and label is not null").groupBy("item", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    items = per.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m >= 2")
    observed = items.agg(F.count(F.lit(1)).alias("items"), F.sum("m").cast("bigint").alias("votes"), F.sum(F.col("same") / (F.col("m") - 1)).alias("o"), F.sum("m").alias("total"))
    shares = per.join(items.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("n").alias("n"))
    chance = shares.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("e"))
    share = F.try_divide("o", "total")
    expected = F.try_divide(F.col("e"), F.col("total") * (F.col("total") - 1))
    return observed.crossJoin(chance).select("items", "votes", share.alias("agreeing_share"), F.when(expected == 1, F.lit(1.0)).otherwise((share - expected) / (1 - expected)).alias("alpha"))
