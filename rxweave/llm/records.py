"""Description records of the two tables: one row per (source, text id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def description_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, text_id, text, split_name`` of every description delivered by either table, repeats included."""
    own = table(spark, sf_dir, "conflicts").select(
        F.lit("conflicts").alias("source"), F.col("id").alias("text_id"), "text", "split_name"
    )
    used = (
        table(spark, sf_dir, "keyword_smoke10")
        .select(F.explode("interactions").alias("x"), "split_name")
        .select(
            F.lit("keyword_smoke10").alias("source"),
            F.col("x.text_id").alias("text_id"),
            F.col("x.drugbank_description").alias("text"),
            "split_name",
        )
    )
    return own.unionByName(used).where("text_id is not null")


def one_per_id(records: DataFrame) -> DataFrame:
    """One row per (source, text_id). Where deliveries disagree, the greatest text and split hold; a null loses."""
    return records.groupBy("source", "text_id").agg(F.max("text").alias("text"), F.max("split_name").alias("split_name"))
