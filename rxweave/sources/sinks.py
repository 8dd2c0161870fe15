"""Writers: bucketed and chunked tables, CSV without nested columns, JSON metrics, resumable results; model coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.search import chunked, pending


def save_bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by ``key``: later joins and aggregations on it need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_chunks(rows: DataFrame, path: str, order: str, chunks: int, columns: list[str]) -> None:
    """JSON lines in ``chunks`` folders of consecutive rows; the last chunk takes the rest."""
    chunked(rows, order, chunks).select(*columns, "chunk").repartition("chunk").write.mode("overwrite").partitionBy("chunk").json(path)


def flat(rows: DataFrame) -> DataFrame:
    """Without the columns that CSV cannot hold: arrays, maps and structs."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return rows.select(*(f.name for f in rows.schema.fields if not isinstance(f.dataType, nested)))


def write_csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").csv(path, header=True, escape='"')


def as_json(rows: DataFrame) -> DataFrame:
    """``json``: every row as one JSON object, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def resume(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What an interrupted run has written so far; no rows if there is nothing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def append_pending(work: DataFrame, compute, path: str, schema: str, key: list[str]) -> int:
    """Computes and appends only what the results at ``path`` lack or hold with errors; returns how many rows that was.

    A batch is committed as a whole or not at all, so a lost run leaves no half-written rows. Rows that had errors stay
    beside the new ones; readers take the last by ``_batch``.
    """
    spark = work.sparkSession
    done = resume(spark, path, f"{schema}, _batch bigint")
    todo = pending(work, done, key)
    batch = (done.agg(F.max("_batch")).first()[0] or 0) + 1
    made = compute(todo).withColumn("_batch", F.lit(batch).cast("bigint"))
    before = done.count()
    made.write.mode("append").parquet(path)
    return resume(spark, path, f"{schema}, _batch bigint").count() - before


def latest(results: DataFrame, key: list[str]) -> DataFrame:
    """The rows of the last batch of each key."""
    others = [c for c in results.columns if c not in (*key, "_batch")]
    return results.groupBy(*key).agg(F.max_by(F.struct(*others), "_batch").alias("x")).select(*key, "x.*")


def coefficients(spark: SparkSession, weights: dict[str, float], intercept: float) -> DataFrame:
    """``feature, weight`` of a linear model as a table, the intercept among them."""
    return spark.createDataFrame([*weights.items(), ("intercept", intercept)], "feature string, weight double")
