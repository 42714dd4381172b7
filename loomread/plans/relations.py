"""Queries on intervals, neighbours, sets and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomread.functions.sequences import micros
from loomread.operators import intervals as I
from loomread.operators import neighbors as N
from loomread.operators.components import connected_components
from loomread.operators.graphs import breadth_first
from loomread.storage import stored


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _a(s, d):
    """Intervals in days by supplier: from shipping, as long as the quantity."""
    day = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)")
    return _t(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("k"), day.cast("long").alias("start"), (day + F.col("l_quantity")).cast("long").alias("stop"))


def _b(s, d):
    day = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)")
    return _t(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"), day.cast("long").alias("start"), (day + 5).cast("long").alias("stop"))


def _sets(s, d):
    return _t(s, d, "lineitem").select("l_suppkey", "l_partkey")


def _pairs(s, d, least=6):
    return N.shared_counts(_sets(s, d), "l_suppkey", "l_partkey", least)


def _edges(s, d):
    """Parts of an order, one after another: a directed graph with an edge from line to next line where quantities agree."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    r = _t(s, d, "lineitem").select(F.col("l_partkey").alias("u"), F.lead("l_partkey").over(w).alias("v"), "l_quantity", F.lead("l_quantity").over(w).alias("q2"))
    return r.where("v is not null and u <> v and abs(l_quantity - q2) <= 1").select("u", "v").distinct()


def closest_left(s, d):
    e = _t(s, d, "events").select("event_id", F.col("user_id").alias("k"), (micros(F.col("ts")) / 1000000).cast("long").alias("t"), "event_type")
    reg = e.where("event_type = 'purchase'").select("k", F.col("t").alias("start"))
    return I.closest_left(e, reg, "k", "t", "event_id").select("event_id", "region_start", "gap")


def tiling(s, d):
    """Consecutive intervals of a supplier, sorted: gaps (negative: overlaps) between neighbours."""
    w = Window.partitionBy("k").orderBy("start", "stop")
    return _b(s, d).select("k", "start", "stop", (F.lead("start").over(w) - F.col("stop")).alias("gap")).where("gap is not null")


def degrees(s, d):
    e = _edges(s, d)
    n = e.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return n.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def bfs_depth(s, d):
    """Distance from the smallest part of every part that it reaches."""
    e = stored(_edges(s, d), "bfs-edges")
    return breadth_first(e, e.agg(F.min("u").alias("node")).where("node is not null"))


def pop_bubbles(s, d):
    """Of two-step paths u > m > w where m has one way in and one out, the least m of each (u, w) stays; the others are popped."""
    e = _edges(s, d)
    one = degrees(s, d).where("n_out = 1 and n_in = 1").select(F.col("node").alias("m"))
    p = e.select("u", F.col("v").alias("m")).join(one, "m").join(e.select(F.col("u").alias("m"), F.col("v").alias("w")), "m").where("u <> w")
    return p.withColumn("popped", F.col("m") != F.min("m").over(Window.partitionBy("u", "w"))).select("u", "m", "w", "popped")


def contraction(s, d):
    """Unbranched chains: an edge is contracted if its source has one way out and its target one way in; chains are components of those edges."""
    e, g = _edges(s, d), degrees(s, d)
    c = e.join(g.where("n_out = 1").select(F.col("node").alias("u")), "u").join(g.where("n_in = 1").select(F.col("node").alias("v")), "v")
    return connected_components(c, "u", "v").groupBy(F.col("component").alias("chain")).agg(F.count("*").alias("n"))


def hairy_edges(s, d):
    """Edges into dead ends whose source has another way out."""
    e, g = _edges(s, d), degrees(s, d)
    return e.join(g.where("n_out = 0 and n_in = 1").select(F.col("node").alias("v")), "v").join(g.where("n_out > 1").select(F.col("node").alias("u")), "u").select("u", "v")


def gfa_lines(s, d):
    """S and L records of the graph; a link only if its target is greater than its source."""
    e = _edges(s, d)
    n = e.select("u").union(e.select("v")).distinct().join(_t(s, d, "part").select(F.col("p_partkey").alias("u"), "p_name"), "u")
    return n.select(F.concat_ws("\t", F.lit("S"), "u", "p_name").alias("line")).unionAll(e.where("v > u").select(F.concat_ws("\t", F.lit("L"), "u", F.lit("+"), "v", F.lit("+"), F.lit("0M")).alias("line")))


def star_links(s, d):
    """Reciprocal strongest links of suppliers."""
    t = N.top_links(_pairs(s, d), 1).select("node", "other", "n")
    return t.join(t.select(F.col("other").alias("node"), F.col("node").alias("other")), ["node", "other"]).where("node < other")


def set_merge(s, d):
    """Suppliers whose part sets overlap by 0.05 of the smaller one or more, merged into components."""
    p = _pairs(s, d, 2).where(F.col("n") >= 0.05 * F.least("na", "nb")).select("a", "b")
    return connected_components(p, "a", "b").select(F.col("node").alias("l_suppkey"), "component")


def flip_columns(s, d):
    """One pass of column flips: per user and event type, whether flipping the sign of its arms agrees with more rows of the user."""
    r = _t(s, d, "events").select("user_id", "event_type", F.when(F.col("value") >= 50, 1).otherwise(-1).alias("arm"))
    c = r.groupBy("user_id", "event_type").agg(F.sum("arm").alias("s"))
    all_ = F.sum("s").over(Window.partitionBy("user_id"))
    return c.select("user_id", "event_type", (F.signum("s") * F.signum(all_ - F.col("s")) < 0).alias("flip"))


def gap_sizing(s, d):
    """Median gap in seconds between neighbouring events of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = (micros(F.col("ts")) / 1000000).cast("long")
    r = _t(s, d, "events").select("user_id", (t - F.lag(t).over(w)).alias("g")).where("g is not null")
    return r.groupBy("user_id").agg(F.round(F.percentile("g", 0.5), 3).alias("gap"))


def _flagged(s, d, flag):
    return _t(s, d, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey")


def _users(s, d, kind):
    return _t(s, d, "events").where(F.col("event_type") == kind).select("user_id")


QUERIES = {
    "interval_merge": lambda s, d: I.merge(_a(s, d), "k"),
    "intersect": lambda s, d: I.intersect(_a(s, d), _b(s, d), "k", 64),
    "subtract": lambda s, d: I.subtract(_a(s, d), _b(s, d), "k"),
    "overlap_semi": lambda s, d: I.overlap_join(_b(s, d).distinct(), _a(s, d), "k", 64).select("k", "start", "stop").distinct(),
    "no_overlap_anti": lambda s, d: _b(s, d).distinct().join(I.overlap_join(_b(s, d).distinct(), _a(s, d), "k", 64).select("k", "start", "stop").distinct(), ["k", "start", "stop"], "left_anti"),
    "closest_left": closest_left,
    "tiling": tiling,
    "depth_profile": lambda s, d: I.depth(_a(s, d), "k"),
    "total_size": lambda s, d: I.merge(_a(s, d), "k").groupBy("k").agg(F.sum(F.col("stop") - F.col("start")).alias("size"), F.count("*").alias("n")),
    "shared_key_join": lambda s, d: _pairs(s, d),
    "jaccard_pairs": lambda s, d: N.jaccard(_pairs(s, d)),
    "overlap_distance": lambda s, d: N.overlap_distance(_pairs(s, d), 1.5e6, 8.0),
    "top5_links": lambda s, d: N.top_links(_pairs(s, d), 5),
    "neighbor_10pct": lambda s, d: N.within_share_of_best(_pairs(s, d, 2), 0.1),
    "minhash_signature": lambda s, d: N.minhash(_sets(s, d), "l_suppkey", "l_partkey", 4),
    "minhash_query": lambda s, d: N.minhash_matches(_sets(s, d), "l_suppkey", "l_partkey", 16, 0.1),
    "set_merge_components": set_merge,
    "set_union": lambda s, d: _users(s, d, "click").union(_users(s, d, "purchase")).distinct(),
    "set_diff": lambda s, d: _flagged(s, d, "A").subtract(_flagged(s, d, "R")),
    "set_intersect": lambda s, d: _users(s, d, "click").intersect(_users(s, d, "purchase")),
    "set_meet": lambda s, d: N.shared_counts(_t(s, d, "events"), "event_type", "user_id", 1).select("a", "b", (F.col("n") > 0).alias("meet"), "n"),
    "set_disjoint": lambda s, d: _t(s, d, "part").select("p_partkey").join(_t(s, d, "lineitem").where("l_discount > 0.09 and l_quantity > 25").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"),
    "degrees": degrees,
    "sources_sinks": lambda s, d: degrees(s, d).where("n_in = 0 or n_out = 0").select("node", F.when(F.col("n_in") == 0, "source").otherwise("sink").alias("kind")),
    "hairy_edges": hairy_edges,
    "components": lambda s, d: connected_components(_edges(s, d), "u", "v"),
    "bfs_depth": bfs_depth,
    "pop_bubbles": pop_bubbles,
    "contraction": contraction,
    "gfa_lines": gfa_lines,
    "star_links": star_links,
    "flip_columns": flip_columns,
    "gap_sizing": gap_sizing,
}

_DAY = "epoch_us(l_shipdate) // 86400000000"
_A = f"a AS (SELECT l_suppkey AS k, {_DAY} AS start, {_DAY} + l_quantity::BIGINT AS stop FROM lineitem WHERE l_returnflag = 'A')"
_B = f"b AS (SELECT l_suppkey AS k, {_DAY} AS start, {_DAY} + 5 AS stop FROM lineitem WHERE l_returnflag = 'R')"


def _merge(x: str) -> str:
    return f"""{x}1 AS (SELECT *, max(stop) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM {x}),
{x}2 AS (SELECT *, sum(CASE WHEN start < hi THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {x}1),
{x}m AS (SELECT k, min(start) AS start, max(stop) AS stop, count(*) AS n FROM {x}2 GROUP BY k, run)"""


_P = """m AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS i FROM lineitem), z AS (SELECT g, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT x.g AS a, y.g AS b, count(*) AS n FROM m x JOIN m y ON x.i = y.i AND x.g < y.g GROUP BY 1, 2),
q AS (SELECT a, b, p.n, za.n AS na, zb.n AS nb FROM p JOIN z za ON a = za.g JOIN z zb ON b = zb.g)"""
_BOTH = "o AS (SELECT a AS node, b AS other, n FROM q WHERE n >= {0} UNION ALL SELECT b, a, n FROM q WHERE n >= {0})"
_G = """e AS (SELECT DISTINCT u, v FROM (SELECT l_partkey AS u, lead(l_partkey) OVER w AS v, l_quantity AS q1, lead(l_quantity) OVER w AS q2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) WHERE v IS NOT NULL AND u <> v AND abs(q1 - q2) <= 1),
g AS (SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT u AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT v, 0, 1 FROM e) GROUP BY 1)"""
_REACH = "reach AS (SELECT n AS a, n AS b FROM (SELECT u AS n FROM c UNION SELECT v FROM c) UNION SELECT r.a, x.v FROM reach r JOIN (SELECT u, v FROM c UNION SELECT v, u FROM c) x ON r.b = x.u), k AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)"
ORACLE_SQL = {
    "interval_merge": f"WITH {_A}, {_merge('a')} SELECT k, start, stop, n FROM am",
    "intersect": f"WITH {_A}, {_B}, {_merge('a')}, {_merge('b')} SELECT am.k, greatest(am.start, bm.start) AS start, least(am.stop, bm.stop) AS stop FROM am JOIN bm ON am.k = bm.k AND am.start < bm.stop AND bm.start < am.stop",
    "subtract": f"""WITH {_A}, {_B}, days AS (SELECT k, unnest(range(start, stop)) AS x FROM a EXCEPT SELECT k, unnest(range(start, stop)) FROM b),
r AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS run FROM days) SELECT k, min(x) AS start, max(x) + 1 AS stop FROM r GROUP BY k, run""",
    "overlap_semi": f"WITH {_A}, {_B} SELECT DISTINCT * FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.start < b.stop AND b.start < a.stop)",
    "no_overlap_anti": f"WITH {_A}, {_B} SELECT DISTINCT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.start < b.stop AND b.start < a.stop)",
    "closest_left": """WITH e AS (SELECT event_id, user_id AS k, epoch_us(ts) // 1000000 AS t, event_type FROM events), r AS (SELECT DISTINCT k, t AS start FROM e WHERE event_type = 'purchase')
SELECT event_id, start AS region_start, t - start AS gap FROM e ASOF LEFT JOIN r ON e.k = r.k AND e.t >= r.start""",
    "tiling": f"WITH {_B} SELECT * FROM (SELECT k, start, stop, lead(start) OVER (PARTITION BY k ORDER BY start, stop) - stop AS gap FROM b) WHERE gap IS NOT NULL",
    "depth_profile": f"""WITH {_A}, x AS (SELECT k, start AS pos, 1 AS d FROM a UNION ALL SELECT k, stop, -1 FROM a), y AS (SELECT k, pos, sum(d) AS d FROM x GROUP BY 1, 2)
SELECT * FROM (SELECT k, pos AS start, lead(pos) OVER (PARTITION BY k ORDER BY pos) AS stop, sum(d) OVER (PARTITION BY k ORDER BY pos)::BIGINT AS depth FROM y) WHERE depth > 0""",
    "total_size": f"WITH {_A}, {_merge('a')} SELECT k, sum(stop - start)::BIGINT AS size, count(*) AS n FROM am GROUP BY k",
    "shared_key_join": f"WITH {_P} SELECT * FROM q WHERE n >= 6",
    "jaccard_pairs": f"WITH {_P} SELECT a, b, round(n / (na + nb - n), 6) AS jaccard FROM q WHERE n >= 6",
    "overlap_distance": f"WITH {_P} SELECT * FROM (SELECT a, b, round(-ln(greatest(1.0, n - na * nb / 1.5e6) * (na + nb - n) / (na * nb)), 6) AS distance FROM q WHERE n >= 6) WHERE distance < 8.0",
    "top5_links": f"WITH {_P}, {_BOTH.format(6)} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, other)::INTEGER AS rank FROM o) WHERE rank <= 5",
    "neighbor_10pct": f"WITH {_P}, {_BOTH.format(2)} SELECT node, other, n FROM (SELECT *, max(n) OVER (PARTITION BY node) AS best FROM o) WHERE n >= 0.1 * best",
    "minhash_signature": "SELECT l_suppkey, " + ", ".join(f"min(md5('{k}/' || l_partkey)) AS h{k}" for k in range(4)) + " FROM lineitem GROUP BY 1",
    "minhash_query": """WITH m AS (SELECT l_suppkey, k, min(md5(k || '/' || l_partkey)) AS h FROM lineitem, range(16) t(k) GROUP BY 1, 2)
SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM m x JOIN m y ON x.k = y.k AND x.h = y.h AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) > 1.6""",
    "set_merge_components": f"WITH RECURSIVE {_P}, c AS (SELECT a AS u, b AS v FROM q WHERE n >= 2 AND n >= 0.05 * least(na, nb)), {_REACH} SELECT node AS l_suppkey, component FROM k",
    "set_union": "SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'purchase')",
    "set_diff": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'",
    "set_intersect": "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'",
    "set_meet": "WITH m AS (SELECT DISTINCT event_type AS g, user_id AS i FROM events) SELECT x.g AS a, y.g AS b, true AS meet, count(*) AS n FROM m x JOIN m y ON x.i = y.i AND x.g < y.g GROUP BY 1, 2",
    "set_disjoint": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 25)",
    "degrees": f"WITH {_G} SELECT * FROM g",
    "sources_sinks": f"WITH {_G} SELECT node, CASE WHEN n_in = 0 THEN 'source' ELSE 'sink' END AS kind FROM g WHERE n_in = 0 OR n_out = 0",
    "hairy_edges": f"WITH {_G} SELECT u, v FROM e JOIN g x ON x.node = v JOIN g y ON y.node = u WHERE x.n_out = 0 AND x.n_in = 1 AND y.n_out > 1",
    "components": f"WITH RECURSIVE {_G}, c AS (SELECT u, v FROM e), {_REACH} SELECT * FROM k",
    "bfs_depth": f"""WITH RECURSIVE {_G}, w AS (SELECT min(u) AS node, 0 AS depth FROM e UNION SELECT v, depth + 1 FROM w JOIN e ON node = u WHERE depth < 100) SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY 1""",
    "pop_bubbles": f"""WITH {_G}, p AS (SELECT x.u, x.v AS m, y.v AS w FROM e x JOIN e y ON x.v = y.u JOIN g ON g.node = x.v WHERE n_in = 1 AND n_out = 1 AND x.u <> y.v) SELECT u, m, w, m <> min(m) OVER (PARTITION BY u, w) AS popped FROM p""",
    "contraction": f"""WITH RECURSIVE {_G}, c AS (SELECT u, v FROM e JOIN g x ON x.node = u JOIN g y ON y.node = v WHERE x.n_out = 1 AND y.n_in = 1), {_REACH} SELECT component AS chain, count(*) AS n FROM k GROUP BY 1""",
    "gfa_lines": f"""WITH {_G} SELECT 'S' || chr(9) || node || chr(9) || p_name AS line FROM g JOIN part ON p_partkey = node UNION ALL SELECT 'L' || chr(9) || u || chr(9) || '+' || chr(9) || v || chr(9) || '+' || chr(9) || '0M' FROM e WHERE v > u""",
    "star_links": f"WITH {_P}, {_BOTH.format(6)}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, other) AS r FROM o) WHERE r = 1) SELECT x.node, x.other, x.n FROM t x JOIN t y ON x.node = y.other AND x.other = y.node WHERE x.node < x.other",
    "flip_columns": """WITH c AS (SELECT user_id, event_type, sum(CASE WHEN value >= 50 THEN 1 ELSE -1 END) AS s FROM events GROUP BY 1, 2)
SELECT user_id, event_type, sign(s) * sign(sum(s) OVER (PARTITION BY user_id) - s) < 0 AS flip FROM c""",
    "gap_sizing": "WITH r AS (SELECT user_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT user_id, round(quantile_cont(g, 0.5), 3) AS gap FROM r WHERE g IS NOT NULL GROUP BY 1",
}
