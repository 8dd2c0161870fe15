from pyspark.sql import functions as F

from rxweave.queries import queries
from rxweave.streaming import metrics as M


def test_stream_equals_batch_up_to_the_watermark(spark, data):
    batch = {tuple(r) for r in queries()["error_ratio_5m"](spark, data).collect()}
    stream = {tuple(r) for r in queries()["stream_rate_5m"](spark, data).collect()}
    assert stream and stream <= batch
    open_from = max(r[0] for r in stream)
    assert all(r in stream for r in batch if r[0] < open_from)


def test_histogram_and_quantile(spark):
    events = spark.createDataFrame([("a", 0.02), ("a", 0.2), ("a", 20.0), ("a", None), ("b", 0.001)], "k string, v double")
    h = M.histogram(events, ["k"], F.col("v"))
    got = {(r.k, r.le): r.n for r in h.collect()}
    assert got[("a", 0.01)] == 0 and got[("a", 0.025)] == 1 and got[("a", 10.0)] == 2 and got[("a", float("inf"))] == 3
    q = {r.k: r.value for r in M.quantile_of_buckets(h, ["k"], 0.95).collect()}
    assert q["a"] == 10.0 and abs(q["b"] - 0.00475) < 1e-9
    assert M.histogram(events.limit(0), ["k"], F.col("v")).count() == 0


def test_sliding_counts_equal_the_windows(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    plain = M.windowed(e, ["event_type"], "5 minutes", "15 seconds", n=F.count(F.lit(1))).select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n")
    fast = M.sliding_counts(e, ["event_type"], 20, 15)
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in fast.select("window_start", "event_type", "n").collect()}
