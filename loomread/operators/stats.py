"""Weighted medians, histograms, moments, quantiles and information measures, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomread.operators.ordinals import running_totals
from loomread.storage import stored

FEW_KEYS = 100_000  # keys of which a row each may be broadcast


def _running(df: DataFrame, keys: list[str], value: str, descending: bool = False) -> DataFrame:
    """Distinct values with their multiplicity, and the running and whole sums of value * multiplicity.

    Equal values are combined first, so windows run over distinct values, not rows.
    """
    each = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.col("v").desc() if descending else F.col("v")).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("s", F.col("v") * F.col("n"))
    return each.withColumns({"cs": F.sum("s").over(order), "total": F.sum("s").over(w), "next": F.lead("v").over(w.orderBy("v"))})


def n50(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """N50 of integer values by group: least v with twice its running sum >= the total; at an exact half the mean of v and its successor."""
    r = _running(df, keys, value).where("2 * cs >= total")
    first = r.groupBy(*keys).agg(F.min_by(F.struct("v", "cs", "total", "next"), "v").alias("f"))
    half = (2 * F.col("f.cs") == F.col("f.total")) & F.col("f.next").isNotNull()
    return first.select(*keys, F.when(half, F.expr("(f.v + f.next) div 2")).otherwise(F.col("f.v")).cast("long").alias("n50"))


def nx(df: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """Largest v such that values >= v hold ``fraction`` of the total."""
    r = _running(df, keys, value, descending=True).where(F.col("cs") >= fraction * F.col("total"))
    return r.groupBy(*keys).agg(F.max("v").alias("nx"))


def interpolated_n(df: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """Scaffold form: the ascending running sum reaches (1 - fraction) of the total inside a value; linear between it and the one before.

    Repeated values are rows of their own here, as the interpolation runs over them.
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy("v", "i")
    r = df.select(*keys, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("i"))
    r = r.withColumns({"cs": F.sum("v").over(o.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("v").over(w), "before": F.coalesce(F.lag("v").over(o), F.lit(0))})
    target = (1 - fraction) * F.col("total")
    hit = r.where((F.col("cs") >= target) & (F.col("cs") - F.col("v") <= target))
    first = hit.groupBy(*keys).agg(F.min_by(F.struct("v", "cs", "total", "before"), "i").alias("f"))
    share = ((1 - fraction) * F.col("f.total") - (F.col("f.cs") - F.col("f.v"))) / F.col("f.v")
    return first.select(*keys, F.floor(F.col("f.before") + share * (F.col("f.v") - F.col("f.before"))).cast("long").alias("n"))


def n_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, x, n): N10 to N90, from the largest down; integer targets total * x div 100."""
    r = _running(df, keys, value, descending=True).withColumn("x", F.explode(F.array(*[F.lit(x) for x in range(10, 100, 10)])))
    return r.where(F.expr("cs >= (total * x) div 100")).groupBy(*keys, "x").agg(F.max("v").alias("n"))


def fixed_histogram(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """(keys, bin, lo, n): bins of ``width`` from the group's minimum; the width shrinks tenfold until the range holds a bin; constant values are one bin."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo0"), F.max(value).alias("hi0"))
    span = F.col("hi0") - F.col("lo0")
    w = F.when((span > 0) & (span < width), width / F.pow(F.lit(10.0), F.ceil(F.log10(width / span)))).otherwise(F.lit(float(width)))
    r = df.join(ends.select(*keys, "lo0", w.alias("w")), keys)
    return r.groupBy(*keys, "lo0", "w", F.floor((F.col(value) - F.col("lo0")) / F.col("w")).alias("bin")).agg(F.count("*").alias("n")).select(*keys, "bin", F.round(F.col("lo0") + F.col("bin") * F.col("w"), 6).alias("lo"), "n")


def moments(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """Count, extremes, mean, sample variance, population skewness and excess kurtosis by group."""
    c = F.col(value)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.round(F.avg(c), digits).alias("mean"), F.round(F.var_samp(c), digits).alias("var"),
                                 F.round(F.skewness(c), digits).alias("skew"), F.round(F.kurtosis(c), digits).alias("kurt"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """-sum p log2 p of the distribution of value by group."""
    each = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return each.withColumn("p", p).groupBy(*keys).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def kl_divergence(p: DataFrame, q: DataFrame, value: str) -> DataFrame:
    """sum p log2(p / q) over values of p; null where q lacks one."""
    count = lambda d, n: d.groupBy(F.col(value).alias("v")).agg(F.count("*").cast("double").alias(n))
    both = count(p, "a").join(count(q, "b"), "v", "left")
    tot = both.agg(F.sum("a").alias("ta")).crossJoin(q.agg(F.count("*").cast("double").alias("tb")))  # one row each
    r = both.crossJoin(F.broadcast(tot))
    pa, pb = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    return r.agg(F.when(F.count("b") == F.count("a"), F.round(F.sum(pa * F.log2(pa / pb)), 6)).alias("kl"))


def weighted_mean(value: str) -> Column:
    """sum v^2 / sum v: the mean size that an element of the whole sees."""
    return F.sum(F.col(value) * F.col(value)) / F.sum(value)


def percentiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, p): the exact percentiles of each key's values, interpolated between neighbours; nulls count for nothing, a key without values has nulls.

    Values are counted first and dealt by ranges; each is told by running totals which ranks it holds, so that no task holds all values of a key.
    """
    counts = stored(df.groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.when(F.col("v").isNull(), 0).otherwise(F.count("*")).alias("n")), "counts")
    total = counts.groupBy("k").agg(F.sum("n").alias("total"))
    some = running_totals(counts.where("n > 0"), ["k", "v"], "n", "before")
    first = some.groupBy("k").agg(F.min("before").alias("first"))
    all_ = total.join(first.withColumnRenamed("k", "own"), F.col("k").eqNullSafe(F.col("own")), "left").select(F.col("k").alias("own"), "total", "first")
    all_ = stored(all_, "keys")
    held = some.join(F.broadcast(all_) if all_.count() <= FEW_KEYS else all_, F.col("k").eqNullSafe(F.col("own"))).withColumn("lo", F.col("before") - F.col("first"))
    at = lambda rank: F.max(F.when((F.col("lo") <= rank) & (rank < F.col("lo") + F.col("n")), F.col("v")))
    place = [(F.col("total") - 1) * F.lit(float(x)) for x in shares]
    found = held.groupBy("k").agg(F.max("total").alias("total"), *[at(g(p)).alias(f"{c}{i}") for i, p in enumerate(place) for c, g in (("a", F.floor), ("b", F.ceil))])
    p = F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (x - F.floor(x)) for i, x in enumerate(place)])
    return all_.select("own").join(found, F.col("own").eqNullSafe(F.col("k")), "left").select(F.col("own").alias(key), p.alias("p"))
