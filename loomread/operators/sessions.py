"""Runs along a coordinate: gap-separated molecules, order scores, ranks, offsets; duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomread.operators.ordinals import running_totals


def molecules(rows: DataFrame, keys: list[str], pos: str, tie: str, gap: float, least: int) -> DataFrame:
    """(keys, molecule, n, start, stop, length): runs of rows no more than ``gap`` apart, with at least ``least`` rows.

    length is (stop - start) * (n + 1) / (n - 1), which corrects for the ends that rows do not reach.
    """
    w = Window.partitionBy(*keys).orderBy(pos, tie)
    r = rows.withColumn("_new", F.coalesce((F.col(pos) - F.lag(pos).over(w) > gap).cast("int"), F.lit(1))).withColumn("molecule", F.sum("_new").over(w))
    m = r.groupBy(*keys, "molecule").agg(F.count("*").alias("n"), F.min(pos).alias("start"), F.max(pos).alias("stop")).where(F.col("n") >= least)
    return m.withColumn("length", F.round((F.col("stop") - F.col("start")) * (F.col("n") + 1) / (F.col("n") - 1), 3))


def order_score(rows: DataFrame, key: str, line: str, pos: str, tie: str, least: float = 2.0) -> DataFrame:
    """(key, score): sum over transitions between lines of gap / mean gap, of those at least ``least``; lower is better."""
    w = Window.partitionBy(key).orderBy(pos, tie)
    r = rows.withColumns({"g": F.col(pos) - F.lag(pos).over(w), "was": F.lag(line).over(w)}).where("g is not null")
    mean = F.avg("g").over(Window.partitionBy(key))
    r = r.withColumn("ratio", F.try_divide(F.col("g"), mean)).where(F.col(line) != F.col("was"))
    return r.where(F.col("ratio") >= least).groupBy(key).agg(F.round(F.sum("ratio"), 6).alias("score"), F.count("*").alias("n"))


def offset_index(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, offset): where each key's rows start when rows are sorted by key; keys are dealt by range."""
    return running_totals(rows.groupBy(key).agg(F.count("*").alias("n")), [key], "n", "offset")


def flag_duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with is_dup: all but the first of equal keys."""
    return rows.withColumn("is_dup", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def group_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(size, groups): how many groups of equal keys have so many rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def close_pairs(rows: DataFrame, keys: list[str], x: str, row_id: str, within: float) -> DataFrame:
    """(keys, pairs): pairs of rows of equal keys whose x differ by at most ``within``.

    Counted by two running positions over the sorted rows (a range frame), so no pair is ever made.
    """
    ahead = Window.partitionBy(*keys).orderBy(x).rangeBetween(-within, 0)
    rank = Window.partitionBy(*keys).orderBy(x, row_id)
    r = rows.withColumns({"_n": F.count("*").over(ahead), "_rn": F.row_number().over(rank), "_upto": F.count("*").over(Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, 0))})
    # rows before this one, in order, that lie within reach
    before = F.col("_n") - (F.col("_upto") - F.col("_rn")) - 1
    return r.groupBy(*keys).agg(F.sum(before).alias("pairs"))


def best_of_group(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the greatest value of each group, the least tie first; one aggregation, no window."""
    other = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*other), F.struct(F.col(value), -F.col(tie))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}") for c in other])
