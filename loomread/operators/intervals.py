"""Interval algebra on half-open [start, stop): merge, intersect, subtract, overlap, closest, depth; binned range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, n): overlapping intervals of a key as one; touching ones stay apart."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    r = df.withColumn("_hi", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_run", F.sum(F.coalesce((F.col("start") >= F.col("_hi")).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("_run")


def _binned(df: DataFrame, width: int) -> DataFrame:
    """A row for each bin of ``width`` that the interval touches."""
    return df.where("stop > start").withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(stop - 1) div {width}"))))


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of overlapping intervals of equal keys: columns of a, and b's as b_*; an equi-join on bins.

    A pair is emitted in the bin of the later start only, so it comes once.
    """
    right = _binned(b, width).select(F.col(key), "_bin", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])
    j = _binned(a, width).join(right, [key, "_bin"]).where("start < b_stop and b_start < stop")
    return j.where(F.expr(f"greatest(start, b_start) div {width} = _bin")).drop("_bin")


def intersect(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """(key, start, stop) of the pieces common to merged a and merged b."""
    j = overlap_join(merge(a, key).drop("n"), merge(b, key).drop("n"), key, width)
    return j.select(key, F.greatest("start", "b_start").alias("start"), F.least("stop", "b_stop").alias("stop"))


def subtract(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, start, stop) of merged a without b, by a sweep over sorted ends."""
    ends = lambda d, n: d.select(key, F.col("start").alias("at"), F.lit(1).alias(n)).unionByName(d.select(key, F.col("stop").alias("at"), F.lit(-1).alias(n)))
    e = ends(a.where("stop > start"), "a").withColumn("b", F.lit(0)).unionByName(ends(b.where("stop > start"), "b").withColumn("a", F.lit(0)))
    e = e.groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(key).orderBy("at")
    e = e.select(key, "at", F.sum("a").over(w).alias("da"), F.sum("b").over(w).alias("db"), F.lead("at").over(w).alias("next")).where("da > 0 and db = 0 and next is not null")
    new = F.coalesce((F.col("at") != F.lag("next").over(w)).cast("int"), F.lit(1))
    r = e.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return r.groupBy(key, "_run").agg(F.min("at").alias("start"), F.max("next").alias("stop")).drop("_run")


def depth(df: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, depth): runs of constant positive depth, by a sweep."""
    e = df.where("stop > start").select(key, F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(df.where("stop > start").select(key, F.col("stop").alias("at"), F.lit(-1).alias("d")))
    e = e.groupBy(key, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("at")
    return e.select(key, F.col("at").alias("start"), F.lead("at").over(w).alias("stop"), F.sum("d").over(w).alias("depth")).where("depth > 0")


def closest_left(points: DataFrame, regions: DataFrame, key: str, pos: str, row_id: str) -> DataFrame:
    """points with region_start and gap of the last region of the key that starts at or before them: an as-of join by union and running last, without a range join."""
    u = points.select(key, F.col(pos).alias("at"), F.lit(1).alias("kind"), F.col(row_id).alias("id"), F.lit(None).cast("long").alias("s")).unionByName(
        regions.select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("start").alias("s")))
    w = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("region_start", F.last("s", True).over(w)).where("kind = 1").select(F.col("id").alias(row_id), key, F.col("at").alias(pos), "region_start", (F.col("at") - F.col("region_start")).alias("gap"))
