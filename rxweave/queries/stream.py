"""Request metrics over the events, as batch queries and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from ..sources.tables import table
from ..streaming import metrics as M
from .registry import query, r6


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("SELECT event_type, user_id % 3 AS status, count(*) AS n FROM events GROUP BY ALL")
def request_counter(spark: SparkSession, d: str) -> DataFrame:
    return M.counter(events(spark, d).withColumn("status", F.col("user_id") % 3), ["event_type", "status"])


BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in M.BUCKETS[:-1]) + ", ('inf'::DOUBLE)"
HIST = f"hs AS (SELECT event_type, le, count(*) FILTER (value / 20 <= le) AS n FROM events, (VALUES {BOUNDS}) b(le) GROUP BY event_type, le)"


@query(f"WITH {HIST} SELECT event_type, le::VARCHAR AS le, n FROM hs WHERE le < 'inf'::DOUBLE UNION ALL SELECT event_type, 'inf', n FROM hs WHERE le = 'inf'::DOUBLE")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = M.histogram(events(spark, d), ["event_type"], F.col("value") / 20)
    return h.select("event_type", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")).alias("le"), "n")


SLIDES = "sl AS (SELECT *, to_timestamp(floor(epoch(ts) / 15) * 15 - 15 * k) AS w FROM events, range(20) r(k))"
UTC = "(w AT TIME ZONE 'UTC')"


@query(f"WITH {SLIDES} SELECT epoch(w)::BIGINT AS window_start, event_type, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM sl GROUP BY ALL")
def rate_5m(spark: SparkSession, d: str) -> DataFrame:
    """Events a second over the last five minutes, every 15 seconds."""
    w = M.sliding_counts(events(spark, d), ["event_type"], 20, 15)
    return w.select("window_start", "event_type", r6(F.col("n") / 300.0).alias("rate"))


HOURS = "hr AS (SELECT *, floor(epoch(ts) / 3600)::BIGINT * 3600 AS w FROM events)"


@query(
    f"""WITH {HOURS}, h AS (SELECT w, event_type, le, count(*) FILTER (value / 20 <= le)::DOUBLE AS n FROM hr, (VALUES {BOUNDS}) b(le) GROUP BY ALL),
s AS (SELECT *, lag(le, 1, 0) OVER o AS low, lag(n, 1, 0) OVER o AS n_low, 0.95::DOUBLE * max(n) OVER (PARTITION BY w, event_type) AS rank FROM h WINDOW o AS (PARTITION BY w, event_type ORDER BY le)),
f AS (SELECT * FROM s WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY w, event_type ORDER BY le) = 1)
SELECT w AS window_start, event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (rank - n_low) / (n - n_low) END, 6) AS p95 FROM f"""
)
def p95_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile per hour and type, interpolated within buckets."""
    hourly = events(spark, d).withColumn("w", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600)
    h = M.histogram(hourly, ["w", "event_type"], F.col("value") / 20)
    return M.quantile_of_buckets(h, ["w", "event_type"], 0.95).select(F.col("w").alias("window_start"), "event_type", r6("value").alias("p95"))


@query("WITH m AS (SELECT floor(epoch(ts) / 300)::BIGINT * 300 AS w, event_type FROM events) SELECT w AS window_start, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_ratio FROM m GROUP BY w")
def error_ratio_5m(spark: SparkSession, d: str) -> DataFrame:
    w = M.windowed(events(spark, d), [], "5 minutes", "5 minutes", bad=F.count_if(F.col("event_type") == "error"), n=F.count(F.lit(1)))
    return w.select(F.unix_timestamp("window_start").alias("window_start"), r6(F.col("bad") / F.col("n")).alias("error_ratio"))


@query("WITH m AS (SELECT floor(epoch(ts) / 300)::BIGINT * 300 AS w, value FROM events) SELECT w AS window_start, round(sum(value) / 300, 6) AS per_second FROM m GROUP BY w")
def interactions_rate(spark: SparkSession, d: str) -> DataFrame:
    w = M.windowed(events(spark, d), [], "5 minutes", "5 minutes", total=F.sum("value"))
    return w.select(F.unix_timestamp("window_start").alias("window_start"), r6(F.col("total") / 300).alias("per_second"))


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def last_gauge(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY user_id")
def error_counter(spark: SparkSession, d: str) -> DataFrame:
    return M.counter(events(spark, d).where("event_type = 'error'"), ["user_id"]).withColumnRenamed("n", "errors")


@query()
def stream_rate_5m(spark: SparkSession, d: str) -> DataFrame:
    """The error ratio of five-minute windows computed as a stream; windows that the watermark has not passed are open."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    w = M.windowed(M.stream_of(spark, d, "events"), [], "5 minutes", "5 minutes", bad=F.count_if(F.col("event_type") == "error"), n=F.count(F.lit(1)))
    return M.drained(w, f"{base}/checkpoint", f"{base}/out").select(F.unix_timestamp("window_start").alias("window_start"), r6(F.col("bad") / F.col("n")).alias("error_ratio"))
