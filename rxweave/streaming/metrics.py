"""Counters, histograms, rates and quantiles over events ``ts, event_type, value``.

Every function takes a batch or a streaming DataFrame. On a stream, rows later than the watermark are dropped, and
windows are emitted once the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import literal_rows

# Upper bounds of the latency buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, float("inf"))
WATERMARK = "10 minutes"


def timed(events: DataFrame) -> DataFrame:
    """``ts`` as a timestamp, with a watermark on a stream; rows without a time are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    return rows.withWatermark("ts", WATERMARK) if events.isStreaming else rows


def counter(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, labels: list[str], length: str, slide: str, **aggs: Column) -> DataFrame:
    """``window_start, labels, aggregates`` over sliding windows."""
    rows = timed(events).groupBy(F.window("ts", length, slide).alias("w"), *labels).agg(*(c.alias(n) for n, c in aggs.items()))
    return rows.select(F.col("w.start").alias("window_start"), *labels, *aggs)


def sliding_counts(events: DataFrame, labels: list[str], slides: int, seconds: int) -> DataFrame:
    """``window_start, labels, n`` (epoch seconds): counts of windows of ``slides`` steps of ``seconds``, one per step.

    Rows are counted per step first; only those counts are copied into the windows that contain the step.
    """
    step = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds
    counts = events.where("ts is not null").groupBy(*labels, step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    spread = counts.select(*labels, "_n", F.explode(F.sequence(F.col("_step") - (slides - 1) * seconds, F.col("_step"), F.lit(seconds).cast("bigint"))).alias("window_start"))
    return spread.groupBy("window_start", *labels).agg(F.sum("_n").alias("n"))


def histogram(events: DataFrame, labels: list[str], value: Column) -> DataFrame:
    """``labels, le, n``: cumulative counts at every bucket bound, and all at infinity.

    A row counts once, in the first bucket that takes it; the running sums are over the twelve bounds.
    """
    first = F.array_min(F.filter(F.array(*map(F.lit, BUCKETS)), lambda b: b >= value))
    per = events.where(value.isNotNull()).groupBy(*labels, first.alias("first")).agg(F.count(F.lit(1)).alias("c"))
    bounds = literal_rows(events.sparkSession, le=list(BUCKETS))
    return per.crossJoin(F.broadcast(bounds)).groupBy(*labels, "le").agg(F.sum(F.when(F.col("first") <= F.col("le"), F.col("c")).otherwise(0)).alias("n"))


def quantile_of_buckets(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """``labels, value``: the quantile interpolated within cumulative buckets; in the last one its lower bound."""
    per = buckets.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))
    total = F.element_at("b", -1)["n"]
    rank = total * q
    at = F.size(F.filter("b", lambda x: x["n"] < rank))
    high, low = F.col("b")[at]["le"], F.when(at == 0, 0.0).otherwise(F.col("b")[F.greatest(at - 1, F.lit(0))]["le"])
    n_high, n_low = F.col("b")[at]["n"], F.when(at == 0, 0).otherwise(F.col("b")[F.greatest(at - 1, F.lit(0))]["n"])
    value = F.when(high == float("inf"), low).otherwise(low + (high - low) * (rank - n_low) / (n_high - n_low))
    return per.where(total > 0).select(*labels, value.alias("value"))


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet table as a file stream: the folder of a partitioned table, or the one file by its name."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if len(spark.read.parquet(path).inputFiles()) > 1:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, checkpoint: str, target: str) -> DataFrame:
    """Runs a streaming aggregation over all there is (``availableNow``) into parquet, and reads the result."""
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
