"""Running totals and global row numbers without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import materialised


def _bucketed(rows: DataFrame, order: str, descending: bool) -> DataFrame:
    """``rows`` with ``_b``, buckets that follow the order: range partitions, as many as the session's shuffles have, so
    their number grows with the cluster. They are written once, so that every later step sees the same buckets."""
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(number, F.desc(order) if descending else F.asc(order))
    return materialised(parts.withColumn("_b", F.spark_partition_id()))


def running_totals(rows: DataFrame, order: str, values: dict[str, str], descending: bool = False, inclusive: bool = True) -> DataFrame:
    """``rows`` with, for each ``new: column`` of ``values``, the sum of the column over all rows up to this one.

    ``order`` must be numeric and unique. Rows are split into buckets by ranges of ``order``; totals per bucket, one row
    each, are accumulated and broadcast, and the rest is a window within each bucket.
    """
    parts = _bucketed(rows, order, descending)
    sums = parts.groupBy("_b").agg(*(F.sum(c).alias(f"_s_{new}") for new, c in values.items()))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_b", *(F.coalesce(F.sum(f"_s_{new}").over(ahead), F.lit(0)).alias(f"_o_{new}") for new in values))
    direction = F.desc(order) if descending else F.asc(order)
    within = Window.partitionBy("_b").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = parts.join(F.broadcast(offsets), "_b")
    return joined.select(*rows.columns, *((F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_o_{new}")).alias(new) for new, c in values.items()))


def numbered(rows: DataFrame, order: str, name: str = "rn") -> DataFrame:
    """``rows`` with their place, from 1, in the order of the unique numeric column ``order``."""
    return running_totals(rows.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"}).drop("_one")


def hash_order(*columns: Column) -> Column:
    """A number that orders rows as the first 15 hexadecimal digits of the MD5 of the columns joined by ``|`` do."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("bigint")
