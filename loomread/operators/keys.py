"""Group keys: matching against a whitelist, counts, repair by edits, lots, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.operators.ordinals import running_totals


def match_keys(rows: DataFrame, key: str, whitelist: DataFrame, listed: str, key_id: str) -> DataFrame:
    """rows with ``key_id`` of their key, null where the whitelist lacks it (a left join on its distinct keys)."""
    return rows.join(whitelist.select(F.col(listed).alias(key), F.col(key_id)).dropDuplicates([key]), key, "left")


def edits(key: Column, alphabet: str, length: int) -> Column:
    """Array of (at, key) for every key with one other character at one place."""
    one = [F.struct(F.lit(i).alias("at"), F.concat(F.substring(key, 1, i), F.lit(c), F.substring(key, i + 2, length)).alias("key")) for i in range(length) for c in alphabet]
    return F.filter(F.array(*one), lambda x: (x["key"] != key) & (F.length(x["key"]) == F.length(key)))


def repair(reads: DataFrame, whitelist: DataFrame, alphabet: str, length: int, least: float = 0.975, single: bool = False) -> DataFrame:
    """(id, key, best, posterior) of reads (id, key, quals) that the whitelist (key, n) lacks.

    Candidates are listed keys one edit away; weight (n + 1) * 10^(-min(33, q) / 10) by the quality at the edit,
    normalised per read. best is given where the posterior is above ``least`` and, unless ``single``, there is more
    than one candidate.
    """
    missing = reads.join(whitelist.select("key"), "key", "left_anti")
    cand = missing.select("id", F.col("key").alias("raw"), "quals", F.explode(edits(F.col("key"), alphabet, length)).alias("e"))
    cand = cand.select("id", "raw", F.col("e.key").alias("key"), F.expr("quals[e.at]").alias("q")).join(whitelist, "key")
    cand = cand.withColumn("w", (F.col("n") + 1) * F.pow(F.lit(10.0), -F.least(F.col("q"), F.lit(33)) / 10))
    best = cand.groupBy("id", "raw").agg(F.sum("w").alias("all"), F.max(F.struct("w", "key")).alias("b"), F.count("*").alias("k"))
    p = F.col("b.w") / F.col("all")
    return best.select("id", F.col("raw").alias("key"), F.when((p > least) & (F.lit(single) | (F.col("k") > 1)), F.col("b.key")).alias("best"), F.round(p, 6).alias("posterior"))


def error_rate(rows: DataFrame, whitelist: DataFrame, key: str, listed: str) -> DataFrame:
    """One row: matched, unmatched and the unmatched share; null share for no rows."""
    m = rows.join(whitelist.select(F.col(listed).alias(key), F.lit(1).alias("ok")).distinct(), key, "left")
    good, n = F.count("ok"), F.count("*")
    return m.agg(good.alias("good"), (n - good).alias("bad"), F.round(F.try_divide(n - good, n), 6).alias("rate"))


def common_keys(rows: DataFrame, key: str, share: float = 0.75) -> DataFrame:
    """(key, n): most frequent keys, until they hold ``share`` of the rows; ties by key. Keys are dealt by range of their counts."""
    c = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), (-F.count("*")).alias("rare"))
    c = running_totals(c, ["rare", "key"], "n", "before")
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).where(F.col("before") < share * F.col("total")).select("key", "n")


def detect_lot(rows: DataFrame, lots: DataFrame, key: str, lot: str, least: float = 0.95, min_rows: int = 1000) -> DataFrame:
    """(lot, n, share, confident) of the lot that most rows' keys belong to; ties to the lesser lot."""
    c = rows.join(lots, key).groupBy(lot).agg(F.count("*").alias("n"))
    tot = c.agg(F.sum("n").alias("total"), F.min_by(F.struct(lot, "n"), F.struct(-F.col("n"), F.col(lot))).alias("b"))
    share = F.col("b.n") / F.col("total")
    return tot.where("total is not null").select(F.col(f"b.{lot}").alias(lot), F.col("b.n").alias("n"), F.round(share, 6).alias("share"), ((share >= least) & (F.col("b.n") >= min_rows)).alias("confident"))
