"""Splits, folds, chunking, trial logs, usage roll-ups and resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.prefix import hash_order, numbered


def folds(rows: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """``rows`` with ``fold``: within each label, rows in hashed order are dealt out in turn.

    The window runs per label and hash bucket, as many as the session's shuffles have partitions, with the sizes of
    earlier buckets added, so a label with a third of all rows is never in one task.
    """
    order = hash_order(F.lit(str(seed)), F.col(key).cast("string"))
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_h", order).withColumn("_b", F.floor(F.col("_h") / F.lit(2**60 // buckets)).cast("int"))
    sizes = placed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(label, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    within = Window.partitionBy(label, "_b").orderBy("_h", key)
    number = F.row_number().over(within) + F.col("_o") - 1
    return placed.join(offsets, [label, "_b"]).select(*rows.columns, (number % k).cast("int").alias("fold"))


def seeded_split(rows: DataFrame, key: str, first: float, seed: int) -> DataFrame:
    """``rows`` with ``part``: the share ``first`` of the rows, in hashed order, is ``train``, the rest ``val``."""
    ordered = numbered(rows.withColumn("_h", hash_order(F.lit(str(seed)), F.col(key).cast("string"))), "_h")
    total = rows.agg(F.floor(F.count(F.lit(1)) * first).alias("_cut"))
    return ordered.crossJoin(F.broadcast(total)).select(*rows.columns, F.when(F.col("rn") <= F.col("_cut"), "train").otherwise("val").alias("part"))


def chunked(rows: DataFrame, order: str, chunks: int) -> DataFrame:
    """``rows`` with ``chunk``: consecutive chunks of ``n // chunks`` rows by the unique ``order``; the last takes the rest."""
    placed = numbered(rows, order)
    size = rows.agg(F.greatest(F.floor(F.count(F.lit(1)) / chunks), F.lit(1)).alias("_size"))
    return placed.crossJoin(F.broadcast(size)).select(*rows.columns, F.least(F.floor((F.col("rn") - 1) / F.col("_size")), F.lit(chunks - 1)).cast("int").alias("chunk"))


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work that has no good result yet: keys without a row in ``done``, or whose rows all have ``errors > 0``."""
    return work.join(done.where(F.coalesce("errors", F.lit(0)) == 0).select(*key), key, "left_anti")


def winner(trials: DataFrame, score: str, params: str, tolerance: float) -> DataFrame:
    """Among the trials within ``tolerance`` of the best score, the one with the fewest parameters; then the best, then the name."""
    best = trials.agg(F.max(score).alias("_best"))
    near = trials.crossJoin(F.broadcast(best)).where(F.col(score) >= F.col("_best") - tolerance).drop("_best")
    return near.orderBy(params, F.desc(score), "trial").limit(1)


def usage(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Roll-up of API calls by ``context`` with a total: an error counts as such and not as a call.

    ``calls``: ``context, error, input_tokens, output_tokens, thinking_tokens, latency``; thinking costs as output does.
    """
    ok = ~F.col("error")
    only = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0))
    agg = calls.rollup("context").agg(
        F.grouping("context").alias("_g"), F.count_if(ok).alias("calls"), F.count_if(F.col("error")).alias("errors"), only("input_tokens").alias("input_tokens"),
        only("output_tokens").alias("output_tokens"), only("thinking_tokens").alias("thinking_tokens"), only("latency").alias("latency"),
    )
    cost = F.col("input_tokens") / 1e6 * price_in + (F.col("output_tokens") + F.col("thinking_tokens")) / 1e6 * price_out
    return agg.select(F.when(F.col("_g") == 1, "total").otherwise(F.col("context")).alias("context"), "calls", "errors", "input_tokens", "output_tokens", "thinking_tokens", "latency", F.coalesce(F.try_divide("latency", "calls"), F.lit(0.0)).alias("avg_latency"), cost.alias("cost"))


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """``value, rank, n``: each distinct value with its average rank; computed on counts per value."""
    from ..plans.prefix import running_totals

    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    below = running_totals(counts, "value", {"below": "n"}, inclusive=False)
    return below.select("value", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"), "n")


def spearman(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r``: rank correlations of all pairs of columns, ties with average ranks."""
    ranked = rows
    for c in columns:
        ranks = average_ranks(rows, c).select(F.col("value").alias("_v"), F.col("rank").alias(f"_r_{c}"))
        ranked = ranked.join(ranks, F.col(c).cast("double") == F.col("_v"), "left").drop("_v")
    cells = [(a, b) for a in columns for b in columns]
    wide = ranked.agg(*(F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a, b in cells))
    parts: list[Column] = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in cells]
    return wide.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
