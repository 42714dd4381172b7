"""Queries on scalars, maps, ordinals, samples and run metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomread.operators.ordinals import ordinals
from loomread.plans.relations import _t

#: The bases that each IUPAC code stands for.
IUPAC_BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def iupac_expansion(s, d):
    """Every sequence that a five-letter site of each page may stand for, a position at a time."""
    sites = _t(s, d, "pages").select("page_id", F.translate(F.substring(F.md5("url"), 1, 5), "0123456789abcdef", "ACGTRYSWKMBDHVNA").alias("site"))
    bases = F.create_map(*[x for k, v in IUPAC_BASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = sites.withColumn("seq", F.lit(""))
    for k in range(5):
        out = out.select("page_id", "site", F.explode(F.transform(F.element_at(bases, F.substring("site", k + 1, 1)), lambda b: F.concat(F.col("seq"), b))).alias("seq"))
    return out.select("page_id", "site", "seq")


def cigar_map(s, d):
    """Per line, offsets of a read's bases on the reference: operations S, M, I, D, M of lengths from its columns.

    A running offset over the operations gives each one's start; M bases take the places from there, S and I bases none.
    """
    n = F.col("l_quantity").cast("int")
    ops = [("S", F.col("l_linenumber")), ("M", n), ("I", F.round(F.col("l_discount") * 100).cast("int")), ("D", F.lit(3)), ("M", F.round(F.col("l_tax") * 100).cast("int"))]
    runs = F.array(*[F.struct(F.lit(o).alias("op"), x.cast("int").alias("n")) for o, x in ops])
    starts = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<op:string,n:int,at:int>>").alias("out")),
                         lambda a, x: F.struct((a["at"] + F.when(x["op"].isin("M", "D"), x["n"]).otherwise(0)).alias("at"), F.concat(a["out"], F.array(F.struct(x["op"].alias("op"), x["n"].alias("n"), a["at"].alias("at")))).alias("out")), lambda a: a["out"])
    places = F.flatten(F.transform(F.filter(starts, lambda x: x["op"].isin("S", "M", "I") & (x["n"] > 0)), lambda x: F.when(x["op"] == "M", F.sequence(x["at"], x["at"] + x["n"] - 1)).otherwise(F.array_repeat(F.lit(None).cast("int"), x["n"]))))
    r = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", places.alias("m"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("m").cast("long").alias("n"), F.size(F.filter("m", lambda x: x.isNull())).cast("long").alias("unplaced"),
                    F.aggregate(F.filter("m", lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"), F.coalesce(F.array_max("m"), F.lit(-1)).cast("long").alias("last"))


def phred_from(p):
    """Phred quality of the probability of no error, at most 60; 0 where it is not a number."""
    q = F.round(-10 * F.log10(1 - p))
    return F.when((p >= 1), 60).when(q.isNull() | F.isnan(q), 0).otherwise(F.least(q, F.lit(60))).cast("long")


def quality_probabilities(s, d):
    """Log probabilities of qualities and the way back, for each pair of quantity and discount."""
    q, p = F.col("l_quantity"), F.col("l_discount")
    r = _t(s, d, "lineitem").select("l_quantity", "l_discount").distinct()
    return r.select("l_quantity", "l_discount", F.round(F.log1p(-F.pow(F.lit(10.0), -0.1 * q)), 9).alias("log_right"), F.round(-0.1 * q / F.log10(F.exp(F.lit(1.0))), 9).alias("log_wrong"),
                    phred_from(1 - p).alias("phred"), F.round(F.coalesce(F.try_divide(q, p), F.lit(float("nan"))), 6).alias("ratio"))


def logsumexp(s, d):
    """log of the sum of exp(value) by user, from each user's largest value, so that nothing overflows."""
    e = _t(s, d, "events").select("user_id", "value")
    top = e.groupBy("user_id").agg(F.max("value").alias("top"))
    return e.join(top, "user_id").groupBy("user_id", "top").agg(F.sum(F.exp(F.col("value") - F.col("top"))).alias("x")).select("user_id", F.round(F.col("top") + F.log("x"), 6).alias("lse"))


def _nested(s, d):
    """(event type, key, number): the nested maps of all users, a row for each entry."""
    return _t(s, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("key"))


def add_maps(s, d):
    """Two-level maps of users added up: sums by outer and inner key."""
    return _nested(s, d).groupBy("event_type", "key").agg(F.count("*").alias("n"))


def argmax_key(s, d):
    """Of each inner map the key with the largest number, the lesser of two."""
    return add_maps(s, d).groupBy("event_type").agg(F.max(F.struct("n", (-F.col("key").cast("long")).alias("k"))).alias("b")).select("event_type", (-F.col("b.k")).cast("string").alias("key"), F.col("b.n").alias("n"))


def discrete_distribution(s, d):
    """Probability and cumulative share of each quantity; the window runs over distinct values."""
    n = _t(s, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return n.select("value", "n", F.round(F.col("n") / F.sum("n").over(w), 9).alias("prob"), F.round(F.sum("n").over(Window.orderBy("value")) / F.sum("n").over(w), 9).alias("ecdf"))


def n50pl(s, d):
    """Piecewise-linear N50 of the quantities by supplier, truncated.

    Sizes rise; the first one with which the running sum reaches half of the whole is mixed with the one before it, by
    how far the half lies in it. Equal sizes are summed first, so a window runs over distinct sizes of a supplier.
    """
    n = _t(s, d, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("long").alias("x")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("l_suppkey").orderBy("x")
    r = n.select("l_suppkey", "x", "m", F.sum(F.col("x") * F.col("m")).over(w).alias("upto"), F.sum(F.col("x") * F.col("m")).over(Window.partitionBy("l_suppkey")).alias("total"), F.coalesce(F.lag("x").over(w), F.lit(0)).alias("prev"))
    r = r.withColumn("before", F.col("upto") - F.col("x") * F.col("m")).where("2 * before <= total and total <= 2 * upto")
    # which of the equal sizes holds the half: the first i with 2 (before + i x) >= total
    i = F.greatest(F.ceil((F.col("total") - 2 * F.col("before")) / (2 * F.col("x"))), F.lit(1))
    frac = (F.col("total") - 2 * (F.col("before") + (i - 1) * F.col("x"))) / (2.0 * F.col("x"))
    low = F.when(i == 1, F.col("prev")).otherwise(F.col("x"))
    return r.select("l_suppkey", "x", F.floor((1 - frac) * low + frac * F.col("x") + 1e-9).alias("v")).groupBy("l_suppkey").agg(F.min_by("v", "x").alias("n50pl"))


def window_stats(s, d):
    """Least, greatest, sum and mean of three neighbours on either side, by user in time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 3)
    return _t(s, d, "events").select("event_id", F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"), F.round(F.sum("value").over(w), 6).alias("sum"), F.round(F.avg("value").over(w), 6).alias("mean"))


def _h(c):
    """A sampling hash of 16 bits that any engine can compute."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 4), 16, 10).cast("long")


def downsample_plan(s, d):
    """The rate at which each event type is kept to give 2,000 rows or a hundredth of the values' sum, whichever is less, with a quarter to spare."""
    n = _t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    want = F.least(F.lit(2000.0), 0.01 * F.col("v"))
    return n.select("event_type", "n", F.round(F.least(F.lit(1.0), 1.25 * want / F.col("n")), 9).alias("rate"))


def lanes_of(cell, count: int):
    """Lanes that a cell of a sample sheet names: a number, a range, ``all`` or ``*``; none where it is not valid or beyond the count."""
    part = lambda i: F.regexp_extract(cell, r"^(\d+)-(\d+)$", i)
    every = F.sequence(F.lit(1), F.lit(count))
    first, last = F.when(part(1) != "", part(1)).cast("int"), F.when(part(2) != "", part(2)).cast("int")
    return (F.when(cell.rlike(r"^\d+$"), F.filter(every, lambda x: x == F.when(cell.rlike(r"^\d+$"), cell).cast("int"))).when(cell.isin("all", "*"), every)
            .when(first < last, F.filter(every, lambda x: (x >= first) & (x <= last))).otherwise(F.array().cast("array<int>")))


def lane_expansion(s, d):
    k = F.col("s_suppkey") % 6
    cell = F.when(k == 0, "all").when(k == 1, "*").when(k == 2, F.col("s_nationkey").cast("string")).when(k == 3, F.concat((F.col("s_nationkey") % 4).cast("string"), F.lit("-"), (F.col("s_nationkey") % 7).cast("string"))).when(k == 4, "x").otherwise("2-9")
    return _t(s, d, "supplier").select("s_suppkey", cell.alias("cell")).select("s_suppkey", "cell", F.explode(lanes_of(F.col("cell"), 4)).alias("lane"))


def _places(s, d):
    """Read names with flow cell, lane, surface, swath, tile and coordinates."""
    name = F.concat_ws(":", F.lit("M1"), F.lit("7"), F.concat(F.lit("FC"), F.col("l_suppkey") % 3), F.col("l_linenumber"), F.concat((F.col("l_orderkey") % 2 + 1).cast("string"), (F.col("l_partkey") % 3 + 1).cast("string"), F.lpad((F.col("l_suppkey") % 12 + 1).cast("string"), 2, "0")), F.col("l_partkey"), F.col("l_orderkey"))
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name.alias("name"))


def _parsed(s, d):
    x = lambda i: F.regexp_extract("name", r"^[^:]+:[^:]+:([^:]+):(\d+):(\d)(\d)(\d\d):(\d+):(\d+)$", i)
    return _places(s, d).select("name", x(1).alias("flowcell"), *[x(i).cast("long").alias(c) for i, c in enumerate(["lane", "surface", "swath", "tile", "x", "y"], 2)])


def tile_extents(s, d):
    return _parsed(s, d).groupBy("flowcell", "lane").agg(*[F.max(c).alias(c) for c in ("x", "y", "swath", "tile")])


def lane_coordinates(s, d):
    """Coordinates on the whole lane: swaths side by side, tiles one below the other; the few extents are broadcast."""
    ext = tile_extents(s, d).select("flowcell", "lane", F.col("x").alias("width"), F.col("y").alias("height"))
    r = _parsed(s, d).join(F.broadcast(ext), ["flowcell", "lane"])
    return r.groupBy("flowcell", "lane").agg(F.sum((F.col("swath") - 1) * F.col("width") + F.col("x")).alias("sum_x"), F.sum((F.col("tile") - 1) * F.col("height") + F.col("y")).alias("sum_y"), F.count("*").alias("n"))


def insert_size(s, d):
    """Distance of each order's neighbouring lines plus the length, where both are of one supplier; none where they are not."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    r = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("c"), F.lead("l_suppkey").over(w).alias("mc"), F.col("l_partkey").alias("p"), F.lead("l_partkey").over(w).alias("mp"), F.col("l_quantity").cast("long").alias("n")).where("mc is not null")
    size = F.when(F.col("c") % 10 == F.col("mc") % 10, F.abs(F.col("p") - F.col("mp")) + F.col("n"))
    return r.groupBy((F.col("c") % 10).alias("contig")).agg(F.count("*").alias("pairs"), F.count(size).alias("mapped"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.sum(size).alias("sum"))


def invert_index(s, d):
    """Supplier > parts turned into part > suppliers: the sorted suppliers of each part as text."""
    r = _t(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return r.groupBy("l_partkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string")), ",").alias("suppliers"))


def _binned(s, d, width=5):
    """Histogram of quantities in bins of a width."""
    return _t(s, d, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_quantity") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def histogram_json(s, d, width=5):
    """A JSON line for each return flag: bin size, first and last bin, and all counts in between."""
    n = _binned(s, d, width)
    ends = n.groupBy("l_returnflag").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    full = ends.select("l_returnflag", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("bin")).join(n, ["l_returnflag", "bin"], "left")
    r = full.groupBy("l_returnflag", "lo", "hi").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("vals"))
    text = F.to_json(F.struct(F.col("l_returnflag").alias("description"), F.lit(width).alias("binsize"), (F.col("lo") * width).alias("min"), (F.col("hi") * width + width).alias("max"), F.size("vals").alias("numbins"), "vals"))
    return r.select("l_returnflag", text.alias("line"))


QUERIES = {
    "iupac_expansion": iupac_expansion,
    "cigar_map": cigar_map,
    "quality_probabilities": quality_probabilities,
    "logsumexp": logsumexp,
    "add_maps": add_maps,
    "argmax_key": argmax_key,
    "discrete_distribution": discrete_distribution,
    "key_distribution": lambda s, d: _t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share")),
    "n50pl": n50pl,
    "window_stats": window_stats,
    "key_ordinal": lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(ordinals(_t(s, d, "lineitem").select("l_orderkey").distinct(), ["l_orderkey"], "ordinal"), "l_orderkey"),
    "zip_by_ordinal": lambda s, d: ordinals(_t(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "i").join(ordinals(_t(s, d, "events").select("event_id"), ["event_id"], "i"), "i"),
    "exact_sample": lambda s, d: _t(s, d, "events").select("event_id", "user_id").orderBy(F.md5(F.col("event_id").cast("string"))).limit(500),
    "bernoulli_sample": lambda s, d: _t(s, d, "events").where(_h(F.col("event_id")) < 6554).select("event_id", "value"),
    "downsample_plan": downsample_plan,
    "prefix_buckets": lambda s, d: _t(s, d, "pages").select(F.when(F.length("html") > 2000, F.substring(F.md5("html"), 1, 2)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")),
    "busy_keys": lambda s, d: _t(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 10).alias("busy")),
    "lane_expansion": lane_expansion,
    "read_place": lambda s, d: _parsed(s, d),
    "tile_extents": tile_extents,
    "lane_coordinates": lane_coordinates,
    "diffusion_screen": lambda s, d: tile_extents(s, d).select("flowcell", "lane", (3.141592653589793 * 25.0 * 25.0 / (F.col("x") * F.col("y")) < 0.025).alias("ok")),
    "insert_size": insert_size,
    "invert_index": invert_index,
    "family_intersection": lambda s, d: _t(s, d, "lineitem").select("l_partkey", "l_linenumber").distinct().groupBy("l_partkey").agg(F.count("*").alias("n")).where("n = 7").select("l_partkey"),
    "family_disjoint": lambda s, d: _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n")).agg((F.count_if(F.col("n") > 1) == 0).alias("disjoint"), F.count_if(F.col("n") > 1).alias("shared")),
    "flat_contents": lambda s, d: _t(s, d, "documents").select("lang", F.explode(F.split("source", "")).alias("x")).where("x <> ''").distinct(),
    "affix_counts": lambda s, d: _t(s, d, "customer").groupBy(F.substring("c_name", 1, 10).alias("prefix"), F.expr("right(c_name, 1)").alias("suffix")).agg(F.count("*").alias("n")),
    "yield_sum": lambda s, d: _t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_discount") * F.col("l_linenumber") * F.col("l_quantity")), 4).alias("yield")),
    "poisson": lambda s, d: _t(s, d, "lineitem").select("l_linenumber", F.col("l_quantity").alias("rate")).distinct().select("l_linenumber", "rate", F.round(F.exp(-F.col("rate")) * F.pow("rate", F.col("l_linenumber").cast("double")) / F.factorial("l_linenumber"), 12).alias("p")),
    "histogram_json": histogram_json,
}

_PART = "regexp_extract(name, '^[^:]+:[^:]+:([^:]+):(\\d+):(\\d)(\\d)(\\d\\d):(\\d+):(\\d+)$', {})"
_NAMES = """n AS (SELECT 'M1:7:FC' || (l_suppkey % 3) || ':' || l_linenumber || ':' || (l_orderkey % 2 + 1) || (l_partkey % 3 + 1) || lpad((l_suppkey % 12 + 1)::VARCHAR, 2, '0') || ':' || l_partkey || ':' || l_orderkey AS name FROM lineitem),
r AS (SELECT name, """ + ", ".join(f"{_PART.format(i)}{'' if i == 1 else '::BIGINT'} AS {c}" for i, c in enumerate(["flowcell", "lane", "surface", "swath", "tile", "x", "y"], 1)) + """ FROM n),
t AS (SELECT flowcell, lane, max(x) AS x, max(y) AS y, max(swath) AS swath, max(tile) AS tile FROM r GROUP BY 1, 2)"""
_MAPS = "m AS (SELECT event_type, json_extract_string(props, '$.k') AS key, count(*) AS n FROM events GROUP BY 1, 2)"
_BASES = "b(c, x) AS (VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in IUPAC_BASES.items() for x in v) + ")"
_CELL = """c AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'all' WHEN 1 THEN '*' WHEN 2 THEN s_nationkey::VARCHAR WHEN 3 THEN (s_nationkey % 4) || '-' || (s_nationkey % 7) WHEN 4 THEN 'x' ELSE '2-9' END AS cell FROM supplier),
e AS (SELECT s_suppkey, cell, try_cast(cell AS INTEGER) AS one, try_cast(nullif(regexp_extract(cell, '^(\\d+)-(\\d+)$', 1), '') AS INTEGER) AS lo, try_cast(nullif(regexp_extract(cell, '^(\\d+)-(\\d+)$', 2), '') AS INTEGER) AS hi FROM c)"""
ORACLE_SQL = {
    "iupac_expansion": f"WITH {_BASES}, s AS (SELECT page_id, translate(substr(md5(url), 1, 5), '0123456789abcdef', 'ACGTRYSWKMBDHVNA') AS site FROM pages) SELECT page_id, site, b1.x || b2.x || b3.x || b4.x || b5.x AS seq FROM s " + " ".join(f"JOIN b b{i} ON b{i}.c = substr(site, {i}, 1)" for i in range(1, 6)),
    "cigar_map": """WITH r AS (SELECT *, l_quantity::INT AS m1, round(l_discount * 100)::INT AS i, round(l_tax * 100)::INT AS m2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_linenumber + m1 + i + m2)::BIGINT AS n, (l_linenumber + i)::BIGINT AS unplaced,
  (m1 * (m1 - 1) // 2 + m2 * (m1 + 3) + m2 * (m2 - 1) // 2)::BIGINT AS sum, (CASE WHEN m2 > 0 THEN m1 + 3 + m2 - 1 ELSE m1 - 1 END)::BIGINT AS last FROM r""",
    "quality_probabilities": """SELECT DISTINCT l_quantity, l_discount, round(ln(1 - pow(10.0, -0.1 * l_quantity)), 9) AS log_right, round(-0.1 * l_quantity / log10(exp(1.0)), 9) AS log_wrong,
  CASE WHEN l_discount <= 0 THEN 60 ELSE least(round(-10 * log10(1 - (1 - l_discount))), 60) END::BIGINT AS phred, round(coalesce(l_quantity / nullif(l_discount, 0), 'NaN'::DOUBLE), 6) AS ratio FROM lineitem""",
    "logsumexp": "SELECT user_id, round(max(m) + ln(sum(exp(value - m))), 6) AS lse FROM (SELECT user_id, value, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1",
    "add_maps": f"WITH {_MAPS} SELECT * FROM m",
    "argmax_key": f"WITH {_MAPS} SELECT event_type, key, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, key::BIGINT) AS r FROM m) WHERE r = 1",
    "discrete_distribution": "WITH n AS (SELECT l_quantity::BIGINT AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, n, round(n / sum(n) OVER (), 9) AS prob, round(sum(n) OVER (ORDER BY value) / sum(n) OVER (), 9) AS ecdf FROM n",
    "key_distribution": "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1",
    "n50pl": """WITH r AS (SELECT l_suppkey, l_quantity::BIGINT AS x, row_number() OVER w AS i, sum(l_quantity::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs, sum(l_quantity::BIGINT) OVER (PARTITION BY l_suppkey) AS t, coalesce(lag(l_quantity::BIGINT) OVER w, 0) AS p
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)),
h AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY i) AS k FROM r WHERE 2 * (cs - x) <= t AND t <= 2 * cs)
SELECT l_suppkey, floor((1 - (t - 2 * (cs - x)) / (2.0 * x)) * p + (t - 2 * (cs - x)) / (2.0 * x) * x + 1e-9)::BIGINT AS n50pl FROM h WHERE k = 1""",
    "window_stats": "SELECT event_id, min(value) OVER w AS lo, max(value) OVER w AS hi, round(sum(value) OVER w, 6) AS sum, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
    "key_ordinal": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dense_rank() OVER (ORDER BY l_orderkey) - 1 AS ordinal FROM lineitem",
    "zip_by_ordinal": "SELECT o_orderkey, event_id, a.i FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) a JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) b ON a.i = b.i",
    "exact_sample": "SELECT event_id, user_id FROM events ORDER BY md5(event_id::VARCHAR) LIMIT 500",
    "bernoulli_sample": "SELECT event_id, value FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 4))::BIGINT < 6554",
    "downsample_plan": "SELECT event_type, count(*) AS n, round(least(1.0, 1.25 * least(2000.0, 0.01 * sum(value)) / count(*)), 9) AS rate FROM events GROUP BY 1",
    "prefix_buckets": "SELECT CASE WHEN length(html) > 2000 THEN substr(md5(html), 1, 2) END AS bucket, count(*) AS n FROM pages GROUP BY 1",
    "busy_keys": "SELECT count(*) AS keys, count(*) FILTER (n > 10) AS busy FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)",
    "lane_expansion": f"""WITH {_CELL} SELECT s_suppkey, cell, l::INTEGER AS lane FROM e, range(1, 5) t(l) WHERE cell IN ('all', '*') OR l = one OR (lo < hi AND l BETWEEN lo AND hi)""",
    "read_place": f"WITH {_NAMES} SELECT * FROM r",
    "tile_extents": f"WITH {_NAMES} SELECT * FROM t",
    "lane_coordinates": f"WITH {_NAMES} SELECT r.flowcell, r.lane, sum((r.swath - 1) * t.x + r.x)::BIGINT AS sum_x, sum((r.tile - 1) * t.y + r.y)::BIGINT AS sum_y, count(*) AS n FROM r JOIN t ON r.flowcell = t.flowcell AND r.lane = t.lane GROUP BY 1, 2",
    "diffusion_screen": f"WITH {_NAMES} SELECT flowcell, lane, 3.141592653589793::DOUBLE * 625 / (x * y) < 0.025 AS ok FROM t",
    "insert_size": """WITH r AS (SELECT l_suppkey % 10 AS c, lead(l_suppkey % 10) OVER w AS mc, l_partkey AS p, lead(l_partkey) OVER w AS mp, l_quantity::BIGINT AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
z AS (SELECT c, CASE WHEN c = mc THEN abs(p - mp) + n END AS size FROM r WHERE mc IS NOT NULL) SELECT c AS contig, count(*) AS pairs, count(size) AS mapped, min(size) AS lo, max(size) AS hi, sum(size)::BIGINT AS sum FROM z GROUP BY 1""",
    "invert_index": "SELECT l_partkey, count(*) AS n, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1",
    "family_intersection": "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 7",
    "family_disjoint": "SELECT count(*) FILTER (n > 1) = 0 AS disjoint, count(*) FILTER (n > 1) AS shared FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey)",
    "flat_contents": "SELECT DISTINCT lang, unnest(string_split(source, '')) AS x FROM documents",
    "affix_counts": "SELECT substr(c_name, 1, 10) AS prefix, right(c_name, 1) AS suffix, count(*) AS n FROM customer GROUP BY 1, 2",
    "yield_sum": "SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_linenumber * l_quantity), 4) AS yield FROM lineitem GROUP BY 1, 2",
    "poisson": "SELECT DISTINCT l_linenumber, l_quantity AS rate, round(exp(-l_quantity) * pow(l_quantity, l_linenumber) / factorial(l_linenumber), 12) AS p FROM lineitem",
    "histogram_json": """WITH n AS (SELECT l_returnflag, floor(l_quantity / 5)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT l_returnflag, min(bin) AS lo, max(bin) AS hi FROM n GROUP BY 1),
f AS (SELECT l_returnflag, lo, hi, unnest(range(lo, hi + 1)) AS bin FROM e)
SELECT l_returnflag, '{"description":"' || l_returnflag || '","binsize":5,"min":' || (lo * 5) || ',"max":' || (hi * 5 + 5) || ',"numbins":' || count(*) || ',"vals":[' || string_agg(coalesce(n, 0), ',' ORDER BY bin) || ']}' AS line
FROM f LEFT JOIN n USING (l_returnflag, bin) GROUP BY l_returnflag, lo, hi""",
}
