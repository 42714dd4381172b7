"""Queries on keys, duplicates and sessions: events as keyed reads, line items as placements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomread.functions.sequences import micros
from loomread.operators import keys as K
from loomread.operators import sessions as M
from loomread.operators.ordinals import ordinals
from loomread.storage import tasks_for


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _events(s, d):
    return _t(s, d, "events").withColumn("t", (micros(F.col("ts")) / 1000000).cast("long"))


def _white(s, d):
    """Customers in credit are the listed keys."""
    return _t(s, d, "customer").where("c_acctbal >= 0").select("c_custkey", (F.floor(F.col("c_custkey") / 2)).alias("key_id"))


def _brands(s, d):
    return _t(s, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("n"))


def _noisy(s, d):
    """Brands with one digit changed by a rule, and qualities by a rule: reads for repair."""
    p = _t(s, d, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    digit = F.concat(F.expr("left(p_brand, length(p_brand) - 1)"), (F.pmod(F.col("id"), F.lit(10))).cast("string"))
    key = F.when(F.col("id") % 3 == 0, digit).otherwise(F.col("p_brand"))
    return p.select("id", key.alias("key"), F.transform(F.sequence(F.lit(0), F.length(key) - 1), lambda i: ((F.col("id") + i) % 40).cast("int")).alias("quals"))


def barcode_check_h2(s, d):
    """Keys exactly two edits from each listed brand that are listed too: neighbours counted per brand."""
    b = _brands(s, d)
    e = b.select("key", F.explode(K.edits(F.col("key"), "0123456789", 8)).alias("e")).select("key", F.col("e.at").alias("a1"), F.col("e.key").alias("k1"))
    e = e.select("key", "a1", F.explode(K.edits(F.col("k1"), "0123456789", 8)).alias("f")).where("f.at > a1").select("key", F.col("f.key").alias("other")).distinct()
    two = e.join(b.select(F.col("key").alias("other"), "n"), "other")
    return b.select("key").join(two.groupBy("key").agg(F.count("*").alias("neighbours"), F.sum("n").alias("rows")), "key", "left").select("key", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.coalesce("rows", F.lit(0)).alias("rows"))


def bc_indexer(s, d):
    """id = n + (group - 1) * N + 1 with n the key's place in the whitelist and N its size; a missing group is 1."""
    w = ordinals(_white(s, d).select("c_custkey"), ["c_custkey"], "n")
    size = w.agg(F.count("*").alias("size"))
    g = F.when(F.col("event_type") == "click", 2).otherwise(1)
    e = _events(s, d).join(w, F.col("user_id") == F.col("c_custkey"), "left").crossJoin(F.broadcast(size))
    return e.select("event_id", F.coalesce(F.col("n") + (g - 1) * F.col("size") + 1, F.lit(0)).cast("long").alias("bc_index"))


def demux_route(s, d):
    return _events(s, d).join(_white(s, d), F.col("user_id") == F.col("c_custkey"), "left").select(
        F.when(F.col("key_id").isNull(), "X").otherwise(F.concat(F.lit("S"), (F.col("key_id") % 8).cast("string"))).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def dup_ladder(s, d):
    """Duplicate share at 1, 1/2, 1/4 and 1/8 of the rows, sampled by md5."""
    r = _t(s, d, "lineitem").select("l_partkey", "l_suppkey", F.expr("conv(substring(md5(concat(l_orderkey, '/', l_linenumber)), 1, 4), 16, 10)").cast("long").alias("h"))
    r = r.select("l_partkey", "l_suppkey", F.explode(F.filter(F.array(*[F.lit(k) for k in (1, 2, 4, 8)]), lambda k: F.col("h") < 65536 / k)).alias("k"))
    g = r.groupBy("k", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return g.groupBy("k").agg(F.sum("n").alias("n"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("dup_share"))


def lw_mean_molecule(s, d):
    m = M.molecules(_events(s, d), ["user_id"], "t", "event_id", 21600, 2)
    return m.agg(F.count("*").alias("n"), F.round(F.sum(F.col("length") * F.col("length")) / F.sum("length"), 4).alias("lw_mean"))


def phasing_rows(s, d, gap=100_000):
    """Per user and run of events no more than ``gap`` seconds apart, the event types seen on one arm only (value below 50, or not)."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    r = _events(s, d).withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    r = r.withColumn("arm", F.when(F.col("value") >= 50, 1).otherwise(-1))
    return r.groupBy("user_id", "run", "event_type").agg(F.min("arm").alias("arm"), F.max("arm").alias("hi"), F.count("*").alias("n")).where("arm = hi").drop("hi")


def running_rank(s, d):
    return _events(s, d).select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("read_id"))


def bridging_test(s, d, near=2, far=6):
    """Suppliers that have parts on both flanks of a part (``near`` to ``far`` keys away on either side), weak if fewer than 10 * min(1, n / reach).

    n are the different suppliers of both flanks; each part is sent to the block of keys, or the two, that it is on a flank in, and all is counted there.
    """
    e = _t(s, d, "lineitem").select("l_partkey", "l_suppkey")
    blocks = F.array_distinct(F.array(F.expr(f"floor((l_partkey - {far}) / 256)"), F.expr(f"floor((l_partkey + {far}) / 256)")))
    e = e.withColumn("block", F.explode(blocks)).repartition(tasks_for(e, 50_000), "block")
    steps = F.array(*[F.lit(x) for x in [*range(-far, -near + 1), 0, *range(near, far + 1)]])
    on = e.select("block", "l_suppkey", "l_partkey", F.explode(steps).alias("step")).select("block", (F.col("l_partkey") - F.col("step")).alias("mid"), "l_suppkey", "step").where("floor(mid / 256) = block")
    side = F.when(F.col("step") != 0, (F.col("step") > 0).cast("int"))
    met = on.groupBy("block", "mid", "l_suppkey").agg(F.min(side).alias("lo"), F.max(side).alias("hi"), F.max(F.col("step") == 0).alias("own"))
    met = met.groupBy("block", "mid").agg(F.count_if(F.col("lo") != F.col("hi")).alias("bridge"), F.count("lo").alias("n"), F.max("own").alias("own")).where("own and n > 0")
    expected = F.floor(10 * F.least(F.lit(1.0), F.col("n") / (far - near + 1)))
    return met.select(F.col("mid").alias("l_partkey"), "bridge", expected.alias("expected"), (F.col("bridge") < expected).alias("weak"))


def line_copy_number(s, d, flanks=(10, 100, 1000)):
    """Per part, twice its rows over the mean rows of the parts at most 10, 100 and 1000 keys away (clipped at the ends of the table), on average over the flanks.

    Range frames run in blocks of keys; each part is also sent to the neighbouring blocks that its widest flank reaches.
    """
    wide = max(flanks)
    c = _t(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("c")).withColumn("home", F.expr(f"l_partkey div {4 * wide}"))
    blocks = F.array_distinct(F.array(F.expr(f"(l_partkey - {wide}) div {4 * wide}"), "home", F.expr(f"(l_partkey + {wide}) div {4 * wide}")))
    r = c.withColumn("block", F.explode(blocks))
    w = Window.partitionBy("block").orderBy("l_partkey")
    near = [F.avg("c").over(w.rangeBetween(-f, f)) for f in flanks]
    cn = sum((2 * F.col("c") / x for x in near), F.lit(0.0)) / len(flanks)
    return r.withColumn("cn", F.round(cn, 6)).where("block = home").select("l_partkey", "c", "cn")


def cell_share_test(s, d):
    """Neighbouring parts with ten suppliers or more each: k shared ones, cut where (k + 4 * sqrt(k)) / the fewer is below 0.25."""
    e = _t(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    n = e.groupBy("l_partkey").agg(F.count("*").alias("n")).where("n >= 10")
    k = e.join(e.select((F.col("l_partkey") - 1).alias("l_partkey"), "l_suppkey"), ["l_partkey", "l_suppkey"]).groupBy("l_partkey").agg(F.count("*").alias("k"))
    r = n.join(n.select((F.col("l_partkey") - 1).alias("l_partkey"), F.col("n").alias("m")), "l_partkey").join(k, "l_partkey", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return r.select("l_partkey", "n", "m", "k", ((F.col("k") + 4 * F.sqrt("k")) / F.least("n", "m") < 0.25).alias("cut"))


QUERIES = {
    "whitelist_match_left": lambda s, d: K.match_keys(_events(s, d).select("event_id", F.col("user_id").alias("key")), "key", _white(s, d), "c_custkey", "key_id").select("event_id", "key_id"),
    "whitelist_anti": lambda s, d: _events(s, d).join(_white(s, d), F.col("user_id") == F.col("c_custkey"), "left_anti").groupBy("user_id").agg(F.count("*").alias("n")),
    "bc_error_rate": lambda s, d: K.error_rate(_events(s, d), _white(s, d), "user_id", "c_custkey"),
    "barcode_repair_h1": lambda s, d: K.repair(_noisy(s, d), _brands(s, d), "0123456789", 8),
    "barcode_check_h2": barcode_check_h2,
    "bc_indexer": bc_indexer,
    "demux_route": demux_route,
    "common_index_pick": lambda s, d: K.common_keys(_events(s, d), "user_id"),
    "lot_detection": lambda s, d: K.detect_lot(_t(s, d, "orders").select(F.col("o_custkey").alias("k")), _t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("lot")), "k", "lot"),
    "molecules": lambda s, d: M.molecules(_events(s, d), ["user_id"], "t", "event_id", 21600, 2),
    "lw_mean_molecule": lw_mean_molecule,
    "phasing_rows": phasing_rows,
    "order_score": lambda s, d: M.order_score(_events(s, d), "user_id", "event_type", "t", "event_id"),
    "running_rank": running_rank,
    "offset_index": lambda s, d: M.offset_index(_events(s, d), "user_id"),
    "dup_flag": lambda s, d: M.flag_duplicates(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]),
    "dup_histogram": lambda s, d: M.group_histogram(_t(s, d, "lineitem"), ["l_partkey", "l_suppkey"]),
    "dup_ladder": dup_ladder,
    "best_of_group": lambda s, d: M.best_of_group(_events(s, d).select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "value", "event_id"),
    "optical_pairs": lambda s, d: M.close_pairs(_events(s, d), ["event_type", "user_id"], "t", "event_id", 3600).where("pairs > 0"),
    "bridging_test": bridging_test,
    "line_copy_number": line_copy_number,
    "cell_share_test": cell_share_test,
}

_E = "SELECT *, epoch_us(ts) // 1000000 AS t FROM events"
_W = "SELECT c_custkey, c_custkey // 2 AS key_id FROM customer WHERE c_acctbal >= 0"
_MOL = f"""r AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600 THEN 0 ELSE 1 END AS b FROM ({_E}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS molecule FROM r),
m AS (SELECT user_id, molecule, count(*) AS n, min(t) AS start, max(t) AS stop, round((max(t) - min(t)) * (count(*) + 1) / (count(*) - 1), 3) AS length FROM g GROUP BY 1, 2 HAVING count(*) >= 2)"""
_BR = "b AS (SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1)"
ORACLE_SQL = {
    "whitelist_match_left": f"SELECT event_id, key_id FROM events LEFT JOIN ({_W}) ON user_id = c_custkey",
    "whitelist_anti": f"SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM ({_W})) GROUP BY 1",
    "bc_error_rate": f"SELECT count(c_custkey) AS good, count(*) - count(c_custkey) AS bad, round((count(*) - count(c_custkey)) / count(*), 6) AS rate FROM events LEFT JOIN ({_W}) ON user_id = c_custkey",
    "barcode_repair_h1": f"""WITH {_BR}, reads AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN substr(p_brand, 1, length(p_brand) - 1) || (p_partkey % 10) ELSE p_brand END AS raw FROM part),
miss AS (SELECT * FROM reads WHERE raw NOT IN (SELECT key FROM b)),
c AS (SELECT id, raw, key, n, i FROM miss JOIN b ON length(raw) = length(key) AND hamming(raw, key) = 1, range(8) t(i) WHERE i < length(raw) AND substr(raw, i + 1, 1) <> substr(key, i + 1, 1) AND regexp_full_match(substr(key, i + 1, 1), '[0-9]')),
w AS (SELECT *, (n + 1) * pow(10.0, -least((id + i) % 40, 33) / 10) AS w FROM c),
s AS (SELECT id, raw, sum(w) AS t, count(*) AS k, max(w) AS mw, arg_max(key, (w, key)) AS best FROM w GROUP BY 1, 2)
SELECT id, raw AS key, CASE WHEN mw / t > 0.975 AND k > 1 THEN best END AS best, round(mw / t, 6) AS posterior FROM s""",
    "barcode_check_h2": f"""WITH {_BR}, e AS (SELECT a.key, b.n FROM b a JOIN b ON length(a.key) = length(b.key) AND hamming(a.key, b.key) = 2)
SELECT b.key, coalesce(x.k, 0) AS neighbours, coalesce(x.r, 0)::BIGINT AS rows FROM b LEFT JOIN (SELECT key, count(*) AS k, sum(n) AS r FROM e GROUP BY 1) x USING (key)""",
    "bc_indexer": f"""WITH w AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM ({_W}))
SELECT event_id, coalesce(n + (CASE WHEN event_type = 'click' THEN 2 ELSE 1 END - 1) * (SELECT count(*) FROM w) + 1, 0) AS bc_index FROM events LEFT JOIN w ON user_id = c_custkey""",
    "demux_route": f"SELECT CASE WHEN key_id IS NULL THEN 'X' ELSE 'S' || (key_id % 8) END AS route, count(*) AS n FROM events LEFT JOIN ({_W}) ON user_id = c_custkey GROUP BY 1",
    "common_index_pick": """WITH c AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM c)
SELECT key, n FROM r WHERE b < 0.75 * t""",
    "lot_detection": """WITH c AS (SELECT c_mktsegment AS lot, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT lot, n, round(n / (SELECT sum(n) FROM c), 6) AS share, n / (SELECT sum(n) FROM c) >= 0.95 AND n >= 1000 AS confident FROM c ORDER BY n DESC, lot LIMIT 1""",
    "molecules": f"WITH {_MOL} SELECT * FROM m",
    "lw_mean_molecule": f"WITH {_MOL} SELECT count(*) AS n, round(sum(length * length) / sum(length), 4) AS lw_mean FROM m",
    "phasing_rows": f"""WITH r AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 100000 THEN 0 ELSE 1 END AS b FROM ({_E}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS run, CASE WHEN value >= 50 THEN 1 ELSE -1 END AS arm FROM r)
SELECT user_id, run, event_type, min(arm) AS arm, count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING min(arm) = max(arm)""",
    "order_score": f"""WITH r AS (SELECT user_id, event_type, t - lag(t) OVER w AS g, lag(event_type) OVER w AS was FROM ({_E}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
q AS (SELECT *, g / nullif(avg(g) OVER (PARTITION BY user_id), 0) AS ratio FROM r WHERE g IS NOT NULL)
SELECT user_id, round(sum(ratio), 6) AS score, count(*) AS n FROM q WHERE event_type <> was AND ratio >= 2.0 GROUP BY 1""",
    "running_rank": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS read_id FROM events",
    "offset_index": "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM c",
    "dup_flag": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) > 1 AS is_dup FROM lineitem",
    "dup_histogram": "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY 1",
    "dup_ladder": """WITH r AS (SELECT l_partkey, l_suppkey, ('0x' || substr(md5(l_orderkey || '/' || l_linenumber), 1, 4))::BIGINT AS h FROM lineitem),
g AS (SELECT k, count(*) AS n FROM r, (VALUES (1), (2), (4), (8)) v(k) WHERE h < 65536 / k GROUP BY k, l_partkey, l_suppkey) SELECT k, sum(n)::BIGINT AS n, round(1 - count(*) / sum(n), 6) AS dup_share FROM g GROUP BY k""",
    "best_of_group": "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1",
    "optical_pairs": f"""WITH e AS ({_E}) SELECT a.event_type, a.user_id, count(*) AS pairs FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND (a.t, a.event_id) < (b.t, b.event_id) AND b.t - a.t <= 3600 GROUP BY 1, 2""",
    "bridging_test": """WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), f AS (SELECT l_partkey - d AS mid, l_suppkey, d > 0 AS r FROM e, (VALUES (-6), (-5), (-4), (-3), (-2), (2), (3), (4), (5), (6)) t(d)),
g AS (SELECT mid, l_suppkey, min(r) <> max(r) AS two FROM f GROUP BY 1, 2), h AS (SELECT mid, count(*) FILTER (two) AS bridge, count(*) AS n FROM g GROUP BY 1)
SELECT mid AS l_partkey, bridge, floor(10 * least(1.0, n / 5))::BIGINT AS expected, bridge < floor(10 * least(1.0, n / 5)) AS weak FROM h WHERE mid IN (SELECT l_partkey FROM lineitem)""",
    "line_copy_number": """WITH c AS (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1)
SELECT l_partkey, c, round((2 * c / avg(c) OVER a + 2 * c / avg(c) OVER b + 2 * c / avg(c) OVER d) / 3, 6) AS cn FROM c
WINDOW a AS (ORDER BY l_partkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING), b AS (ORDER BY l_partkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING), d AS (ORDER BY l_partkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING)""",
    "cell_share_test": """WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT l_partkey, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 10),
k AS (SELECT a.l_partkey, count(*) AS k FROM e a JOIN e b ON b.l_partkey = a.l_partkey + 1 AND a.l_suppkey = b.l_suppkey GROUP BY 1)
SELECT a.l_partkey, a.n, b.n AS m, coalesce(k.k, 0) AS k, (coalesce(k.k, 0) + 4 * sqrt(coalesce(k.k, 0))) / least(a.n, b.n) < 0.25 AS cut FROM n a JOIN n b ON b.l_partkey = a.l_partkey + 1 LEFT JOIN k ON k.l_partkey = a.l_partkey""",
}
