"""Global ordinals without a window over the whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomread.storage import stored


def ordinals(df: DataFrame, by: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: each row's place, from ``start``, in the order of ``by``.

    Rows are dealt by ranges of ``by`` and numbered within a part; only the sizes of the parts are summed in one window.
    Rows with equal ``by`` share a part and take places in any order among themselves. The parts are written once, so that numbers and sizes
    are of the same rows. Nulls come first; an empty table gives an empty result.
    """
    parts = stored(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ordinals")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # a row for each part
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1 + start
    return parts.withColumn("_own", own).join(offsets, "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def running_totals(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before each one in the order of ``by``; parts as in ordinals()."""
    parts = stored(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "totals")
    sizes = parts.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(offsets, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
