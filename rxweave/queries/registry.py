"""The registry of queries and the inputs that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import first_of_each
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB statement that must give the same rows."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def rx(spark: SparkSession, d: str) -> DataFrame:
    """Prescriptions, the latest delivery of each."""
    return first_of_each(table(spark, d, "keyword_smoke10"), ["prescription_id"], [F.desc("loaded_at")])


def rx_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Interactions of prescriptions with their position."""
    return rx(spark, d).select("prescription_id", F.posexplode("interactions").alias("pos", "x")).select("prescription_id", "pos", "x.*")


def evals(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows, repeated ones once."""
    return table(spark, d, "detailed_results").distinct()


def scored(rows: DataFrame) -> DataFrame:
    """Class probabilities of an external scorer, stood in for by fixed arithmetic on the text id."""
    a, b, c = (1 + F.pmod(F.col("text_id") * m, F.lit(n)) for m, n in ((1, 7), (3, 11), (5, 13)))
    total = (a + b + c).cast("double")
    return rows.select("*", (a / total).alias("p_mild"), (b / total).alias("p_mod"), (c / total).alias("p_sev"))


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def key_sql(text: str) -> str:
    return f"lower({strip_sql(text)})"


RX = "rx AS (SELECT * FROM keyword_smoke10 QUALIFY row_number() OVER (PARTITION BY prescription_id ORDER BY loaded_at DESC) = 1)"
PR = RX + ", pr AS (SELECT prescription_id, pos::INT AS pos, x.* FROM (SELECT prescription_id, unnest(range(len(interactions))) AS pos, unnest(interactions) AS x FROM rx))"
EV = "ev AS (SELECT DISTINCT * FROM detailed_results)"
SCORED = """sc AS (SELECT *, a / (a + b + c) AS p_mild, b / (a + b + c) AS p_mod, c / (a + b + c) AS p_sev FROM
    (SELECT *, (1 + text_id % 7)::DOUBLE AS a, (1 + text_id * 3 % 11)::DOUBLE AS b, (1 + text_id * 5 % 13)::DOUBLE AS c FROM pr))"""
