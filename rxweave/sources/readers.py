"""Readers and writers for what the engine takes in besides parquet: JSON knowledge bases, ragged TSV, CSV, JSON lines, chunk files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ragged(lines: DataFrame, line: str, columns: list[str], separator: str = "\t") -> DataFrame:
    """Rows of separated text with the given header: shorter rows are dropped, longer ones cut to the header."""
    parts = F.split(line, separator if separator != "|" else r"\|")
    cut = lines.select(parts.alias("_p")).where(F.size("_p") >= len(columns))
    return cut.select(*(F.col("_p")[k].alias(c) for k, c in enumerate(columns)))


def read_ragged_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV file with a header line; quotes are plain text. An empty file gives no columns."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    head = lines.where("_n = 0").first()
    columns = head.value.rstrip("\t").split("\t") if head else []
    return ragged(lines.where("_n > 0"), "value", columns) if columns else lines.limit(0).select()


def read_csv(spark: SparkSession, path: str, required: str | None = None) -> DataFrame:
    """A CSV file with a header, quoted fields over several lines; rows without the required field are dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.where(F.trim(F.coalesce(required, F.lit(""))) != "") if required else rows


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and lines that are no JSON are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*")


def read_chunks_last_wins(spark: SparkSession, pattern: str, schema: str, key: str) -> DataFrame:
    """JSON-lines files by path pattern; of rows with the same key the one from the last path counts."""
    rows = spark.read.schema(schema).json(pattern).select("*", F.col("_metadata.file_path").alias("_path"))
    others = [c for c in rows.columns if c not in (key, "_path")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "_path").alias("x")).select(key, "x.*")


def strings(value: Column, path: str) -> Column:
    """A field of a variant that may be a string, a list of strings or missing, always as an array."""
    listed = F.try_variant_get(value, path, "array<string>")
    single = F.try_variant_get(value, path, "string")
    return F.coalesce(listed, F.when(single.isNotNull() & ~F.coalesce(single.startswith("{"), F.lit(False)), F.array(single)), F.array().cast("array<string>"))


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a knowledge base in JSON: ``source, source_id, target, target_id, description, pos``.

    The file holds a list of records ``{"name", "id", "interactions": [{"name", "description", "id"}]}``; ids may be a
    string or a list. A missing file gives no rows.
    """
    schema = "source string, source_id string, target string, target_id string, description string, pos int"
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("raw"))
    records = whole.select(F.parse_json("raw").alias("v")).select(F.try_variant_get("v", "$.name", "string").alias("source"), strings(F.col("v"), "$.id").alias("ids"), F.from_json(F.to_json(F.try_variant_get("v", "$.interactions", "variant")), "array<struct<name:string,description:string,id:string>>").alias("edges"))
    flat = records.select("source", F.posexplode("edges").alias("pos", "e"), "ids")
    return flat.select("source", F.explode_outer("ids").alias("source_id"), F.col("e.name").alias("target"), F.col("e.id").alias("target_id"), F.col("e.description").alias("description"), "pos")


def content_hash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``digest``: 16 hexadecimal digits over all rows, whatever their order.

    Every row is hashed where it is, and the hashes are added up as numbers, so nothing is collected; equal rows count
    as often as they occur.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys)), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)") for k in range(2)]
    total = rows.agg(*(F.sum(p).alias(f"p{k}") for k, p in enumerate(parts)), F.count(F.lit(1)).alias("n"))
    return total.select(F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "p0", "p1"))), 256), 1, 16).alias("digest"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, violations`` for every rule; a row breaks a rule where its condition is false or null."""
    wide = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules))).alias("x")).select("x.*")
