"""Queries on line items and orders: distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomread.operators import stats as S


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _qty(s, d):
    return _t(s, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"), "l_extendedprice", "l_orderkey", "l_discount")


def size_histogram(s, d):
    return _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def exact_quantiles(s, d):
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    r = S.percentiles(_t(s, d, "lineitem"), "l_returnflag", "l_extendedprice", q)
    return r.select("l_returnflag", *[F.round(F.get("p", F.lit(i)), 4).alias(f"p{int(x * 100):02d}") for i, x in enumerate(q)])


def generalized_iqr(s, d):
    """Difference of the values at ranks floor(0.9 n) and floor(0.1 n), by return flag."""
    r = _qty(s, d).groupBy("l_returnflag", "q").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_returnflag")
    r = r.withColumns({"hi": F.sum("n").over(w.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    at = lambda f: F.min(F.when(F.col("hi") > F.floor(f * F.col("all")), F.col("q")))
    return r.groupBy("l_returnflag").agg(at(0.1).alias("lo"), at(0.9).alias("hi")).select("l_returnflag", (F.col("hi") - F.col("lo")).alias("iqr"))


def mean_var_counts(s, d):
    """Mean and population variance from a table of counts."""
    c = _qty(s, d).groupBy("l_returnflag", "q").agg(F.count("*").alias("n"))
    m = F.sum(F.col("q") * F.col("n")) / F.sum("n")
    return c.groupBy("l_returnflag").agg(F.round(m, 6).alias("mean"), F.round(F.sum(F.col("q") * F.col("q") * F.col("n")) / F.sum("n") - m * m, 6).alias("var"))


def qc_grouping_sets(s, d):
    r = _t(s, d, "lineitem")
    return s.sql("""SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(avg(l_quantity), 6) AS mean_q,
      round(sum(CASE WHEN l_quantity >= 30 THEN 1 ELSE 0 END) / count(*), 6) AS q30 FROM {r}
      GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""", r=r)


def approx_quantile(s, d):
    """Approximate median beside the exact one: whether it lies within 1 % of the rank."""
    t = _t(s, d, "lineitem")
    a = t.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 10000).alias("a")).select(F.col("l_returnflag").alias("flag"), "a")
    exact = S.percentiles(t, "l_returnflag", "l_extendedprice", [0.49, 0.51])
    return exact.join(a, F.col("l_returnflag").eqNullSafe(F.col("flag"))).select("l_returnflag", F.col("a").between(F.get("p", F.lit(0)), F.get("p", F.lit(1))).alias("close"))


def approx_distinct(s, d):
    """Distinct parts by sketch and exactly; the sketch runs over distinct pairs, so that no pair carries one of its own."""
    r = _t(s, d, "lineitem").select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count("l_partkey").alias("n"))
    return r.select("l_returnflag", "n", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


def rpb_n50(s, d):
    """N50 of rows per key and the share of rows under keys with more than 1.5 times the mean."""
    c = _t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    share = c.crossJoin(F.broadcast(c.agg(F.avg("n").alias("mean")))).agg(F.round(F.sum(F.when(F.col("n") > 1.5 * F.col("mean"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("big_share"))
    return S.n50(c, ["one"], "n").select("n50").crossJoin(share)


def gem_estimate(s, d):
    """Saturation estimate: keys with at least 4 rows among a diversity of all keys; -ln(1 - p) * diversity, 0 if saturated."""
    c = _t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    r = c.agg(F.sum((F.col("n") >= 4).cast("int")).alias("good"), F.count("*").alias("diversity"))
    p = F.col("good") / (F.col("diversity") + 1)
    return r.select("good", "diversity", F.when(p >= 1, 0.0).otherwise(F.round(-F.log(1 - p) * F.col("diversity"), 6)).alias("gems"))


def fragment_histogram(s, d):
    """Distances of successive placements of an order, in days, within 0 to 1000."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    r = _t(s, d, "lineitem").select(F.timestamp_diff("DAY", F.lag("l_shipdate").over(w), F.col("l_shipdate")).alias("days"))
    return r.where(F.col("days").between(0, 1000)).groupBy("days").agg(F.count("*").alias("n"))


def proper_pair_pct(s, d):
    """Share of neighbouring placements of an order within 30 days, in percent."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    r = _t(s, d, "lineitem").select(F.timestamp_diff("DAY", F.lag("l_shipdate").over(w), F.col("l_shipdate")).alias("days"))
    return r.where("days is not null").agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("days") <= 30).cast("int")), 6).alias("pct"))


QUERIES = {
    "n50_by_group": lambda s, d: S.n50(_qty(s, d), ["l_suppkey"], "q"),
    "nx_60": lambda s, d: S.interpolated_n(_qty(s, d), ["l_suppkey"], "q", 0.6),
    "nx_python": lambda s, d: S.nx(_qty(s, d), ["l_suppkey"], "q", 0.5),
    "n_statistics": lambda s, d: S.n_statistics(_qty(s, d), ["l_returnflag"], "q"),
    "fixed_histogram": lambda s, d: S.fixed_histogram(_t(s, d, "lineitem"), ["l_returnflag"], "l_quantity", 7.0),
    "size_histogram": size_histogram,
    "moments": lambda s, d: S.moments(_t(s, d, "lineitem"), ["l_returnflag"], "l_quantity", 4),
    "exact_quantiles": exact_quantiles,
    "entropy": lambda s, d: S.entropy(_qty(s, d), ["l_returnflag"], "q"),
    "kl_divergence": lambda s, d: S.kl_divergence(_qty(s, d).where("l_returnflag = 'A'"), _qty(s, d), "q"),
    "generalized_iqr": generalized_iqr,
    "mean_var_counts": mean_var_counts,
    "qc_grouping_sets": qc_grouping_sets,
    "approx_quantile": approx_quantile,
    "approx_distinct": approx_distinct,
    "rpb_n50": rpb_n50,
    "gem_estimate": gem_estimate,
    "fragment_histogram": fragment_histogram,
    "proper_pair_pct": proper_pair_pct,
    "weighted_mean": lambda s, d: _qty(s, d).groupBy("l_returnflag").agg(F.round(S.weighted_mean("q"), 6).alias("wmean")),
}

_LI = "SELECT *, l_quantity::BIGINT AS q FROM lineitem"
_DIFF = "date_diff('microsecond', lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber), l_shipdate) // 86400000000"
ORACLE_SQL = {
    "n50_by_group": f"""WITH r AS (SELECT l_suppkey, q, i, sum(q) OVER (PARTITION BY l_suppkey ORDER BY q, i) AS cs, sum(q) OVER (PARTITION BY l_suppkey) AS total, lead(q) OVER (PARTITION BY l_suppkey ORDER BY q, i) AS nxt
  FROM (SELECT *, row_number() OVER () AS i FROM ({_LI}))), f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q, i) AS k FROM r WHERE 2 * cs >= total)
SELECT l_suppkey, CASE WHEN 2 * cs = total AND nxt IS NOT NULL THEN (q + nxt) // 2 ELSE q END AS n50 FROM f WHERE k = 1""",
    "nx_60": f"""WITH r AS (SELECT l_suppkey, q, i, sum(q) OVER (PARTITION BY l_suppkey ORDER BY q, i) AS cs, sum(q) OVER (PARTITION BY l_suppkey) AS total, coalesce(lag(q) OVER (PARTITION BY l_suppkey ORDER BY q, i), 0) AS b
  FROM (SELECT *, row_number() OVER () AS i FROM ({_LI}))), f AS (SELECT *, (1 - 0.6::DOUBLE) * total AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY q, i) AS k FROM r WHERE cs >= (1 - 0.6::DOUBLE) * total AND cs - q <= (1 - 0.6::DOUBLE) * total)
SELECT l_suppkey, floor(b + ((t - (cs - q)) / q) * (q - b))::BIGINT AS n FROM f WHERE k = 1""",
    "nx_python": f"""WITH r AS (SELECT l_suppkey, q, sum(q) OVER (PARTITION BY l_suppkey ORDER BY q DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs, sum(q) OVER (PARTITION BY l_suppkey) AS total FROM ({_LI}))
SELECT l_suppkey, max(q) AS nx FROM r WHERE cs >= 0.5 * total GROUP BY l_suppkey""",
    "n_statistics": f"""WITH r AS (SELECT l_returnflag, q, sum(q) OVER (PARTITION BY l_returnflag ORDER BY q DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs, sum(q) OVER (PARTITION BY l_returnflag) AS total FROM ({_LI}))
SELECT l_returnflag, x::INTEGER AS x, max(q) AS n FROM r, range(10, 100, 10) t(x) WHERE cs >= (total * x) // 100 GROUP BY ALL""",
    "fixed_histogram": """WITH e AS (SELECT l_returnflag, min(l_quantity) AS lo0, 7.0::DOUBLE AS w FROM lineitem GROUP BY 1)
SELECT l_returnflag, floor((l_quantity - lo0) / w)::BIGINT AS bin, round(lo0 + floor((l_quantity - lo0) / w) * w, 6) AS lo, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL""",
    "size_histogram": "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size",
    "moments": """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mu FROM lineitem GROUP BY 1), c AS (SELECT l_returnflag, l_quantity AS v, l_quantity - mu AS x FROM lineitem JOIN m USING (l_returnflag))
SELECT l_returnflag, count(*) AS n, min(v) AS lo, max(v) AS hi, round(avg(v), 4) AS mean, round(var_samp(v), 4) AS var, round(avg(x * x * x) / pow(avg(x * x), 1.5), 4) AS skew, round(avg(x * x * x * x) / pow(avg(x * x), 2) - 3, 4) AS kurt FROM c GROUP BY 1""",
    "exact_quantiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {x}), 4) AS p{int(x * 100):02d}" for x in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM lineitem GROUP BY 1",
    "entropy": f"WITH c AS (SELECT l_returnflag, q, count(*) AS n FROM ({_LI}) GROUP BY ALL), p AS (SELECT l_returnflag, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM c) SELECT l_returnflag, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1",
    "kl_divergence": f"""WITH a AS (SELECT q, count(*)::DOUBLE AS a FROM ({_LI}) WHERE l_returnflag = 'A' GROUP BY q), b AS (SELECT q, count(*)::DOUBLE AS b FROM ({_LI}) GROUP BY q),
j AS (SELECT a / (SELECT sum(a) FROM a) AS p, b / (SELECT sum(b) FROM b) AS r FROM a LEFT JOIN b USING (q)) SELECT round(sum(p * log2(p / r)), 6) AS kl FROM j""",
    "generalized_iqr": f"""WITH r AS (SELECT l_returnflag, q, row_number() OVER (PARTITION BY l_returnflag ORDER BY q) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM ({_LI}))
SELECT l_returnflag, max(CASE WHEN i = floor(0.9 * n) THEN q END) - max(CASE WHEN i = floor(0.1 * n) THEN q END) AS iqr FROM r GROUP BY 1""",
    "mean_var_counts": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS var FROM lineitem GROUP BY 1",
    "qc_grouping_sets": """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(avg(l_quantity), 6) AS mean_q,
      round(sum(CASE WHEN l_quantity >= 30 THEN 1 ELSE 0 END) / count(*), 6) AS q30 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "approx_quantile": "SELECT DISTINCT l_returnflag, true AS close FROM lineitem",
    "approx_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, true AS close FROM lineitem GROUP BY 1",
    "rpb_n50": """WITH c AS (SELECT count(*) AS n FROM events GROUP BY user_id), r AS (SELECT n, i, sum(n) OVER (ORDER BY n, i) AS cs, sum(n) OVER () AS total, lead(n) OVER (ORDER BY n, i) AS nxt FROM (SELECT n, row_number() OVER () AS i FROM c)),
f AS (SELECT *, row_number() OVER (ORDER BY n, i) AS k FROM r WHERE 2 * cs >= total)
SELECT CASE WHEN 2 * cs = total AND nxt IS NOT NULL THEN (n + nxt) // 2 ELSE n END AS n50, (SELECT round(sum(CASE WHEN n > 1.5 * (SELECT avg(n) FROM c) THEN n ELSE 0 END) / sum(n), 6) FROM c) AS big_share FROM f WHERE k = 1""",
    "gem_estimate": """WITH c AS (SELECT count(*) AS n FROM events GROUP BY user_id), r AS (SELECT sum((n >= 4)::INT)::BIGINT AS good, count(*) AS diversity FROM c)
SELECT good, diversity, CASE WHEN good / (diversity + 1) >= 1 THEN 0 ELSE round(-ln(1 - good / (diversity + 1)) * diversity, 6) END AS gems FROM r""",
    "fragment_histogram": f"SELECT days, count(*) AS n FROM (SELECT {_DIFF} AS days FROM lineitem) WHERE days BETWEEN 0 AND 1000 GROUP BY days",
    "proper_pair_pct": f"SELECT count(*) AS n, round(100 * avg((days <= 30)::INT), 6) AS pct FROM (SELECT {_DIFF} AS days FROM lineitem) WHERE days IS NOT NULL",
    "weighted_mean": f"SELECT l_returnflag, round(sum(q * q) / sum(q), 6) AS wmean FROM ({_LI}) GROUP BY 1",
}
