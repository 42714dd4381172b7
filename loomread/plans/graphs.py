"""Queries on directed graphs of parts, and their text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomread.operators import graphs as G
from loomread.operators.components import connected_components
from loomread.operators.ordinals import ordinals
from loomread.plans.relations import _G, _REACH, _edges, _t, degrees
from loomread.storage import scratch, stored


def _uses(s, d):
    """(u, v, n, quantity): consecutive parts of orders, how often they are and the largest quantity of the first."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    r = _t(s, d, "lineitem").select(F.col("l_partkey").alias("u"), F.lead("l_partkey").over(w).alias("v"), "l_quantity", "l_suppkey")
    return r.where("v is not null and u <> v")


def _weighted(s, d):
    """Edges with the number of suppliers of both parts in common orders."""
    return _edges(s, d).join(_uses(s, d).groupBy("u", "v").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q")), ["u", "v"])


def _root(e):
    return e.agg(F.min("u").alias("node")).where("node is not null")


def _chains(s, d):
    e, g = _edges(s, d), degrees(s, d)
    return e.join(g.where("n_out = 1").select(F.col("node").alias("u")), "u").join(g.where("n_in = 1").select(F.col("node").alias("v")), "v").select("u", "v")


def small_components(s, d, least=5):
    """Edges without those of components of fewer than ``least`` edges."""
    e = stored(_edges(s, d), "edges")
    named = e.join(connected_components(e, "u", "v").withColumnRenamed("node", "u"), "u")
    big = named.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return named.join(big, "component", "left_semi").select("u", "v")


def simple_hangs(s, d):
    """Edges into dead ends that are used less than another edge of their source."""
    e = _weighted(s, d)
    ends = degrees(s, d).where("n_out = 0 and n_in = 1").select(F.col("node").alias("v"))
    best = e.groupBy("u").agg(F.max("q").alias("best"))
    return e.join(ends, "v").join(best, "u").where("q < best").select("u", "v", "q", "best")


def weak_edges(s, d, ratio=3.0, most=15.0):
    """Edges of at most ``most`` where another edge of the source has ``ratio`` times as much or more; kept says which stay."""
    e = _weighted(s, d)
    best = e.groupBy("u").agg(F.max("q").alias("best"))
    return e.join(best, "u").select("u", "v", "q", (~((F.col("q") <= most) & (F.col("best") >= ratio * F.greatest(F.lit(1.0), F.col("q"))))).alias("kept"))


def validation(s, d):
    """Violations of each rule that a graph has to keep; all should be 0."""
    e, g = _edges(s, d), degrees(s, d)
    rule = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
    r = rule("self loop", e.where("u = v")).unionAll(rule("missing end", e.where("u is null or v is null"))).unionAll(rule("edge twice", e.groupBy("u", "v").count().where("count > 1")))
    sums = g.agg(F.sum("n_in").alias("i"), F.sum("n_out").alias("o"))
    return r.unionAll(rule("degrees differ", sums.where("i <> o"))).unionAll(rule("no such part", e.join(_t(s, d, "part").select(F.col("p_partkey").alias("u")), "u", "left_anti")))


def graph_fasta(s, d):
    """Names of the graph's parts as FASTA records, written and read back by the mark of a record."""
    path = scratch(s, "fasta")
    e = _edges(s, d)
    n = e.select("u").union(e.select("v")).distinct().join(_t(s, d, "part").select(F.col("p_partkey").alias("u"), "p_name"), "u")
    n.select(F.concat(F.lit(">"), "u", F.lit("\n"), "p_name").alias("value")).write.text(path)
    raw = s.read.option("lineSep", ">").text(path).where("value <> ''")
    return raw.select(F.split("value", "\n")[0].cast("long").alias("id"), F.rtrim(F.split("value", "\n")[1]).alias("seq"))


def graph_tsv(s, d):
    """Length of the name, suppliers, ways in and out of each part as tab-separated lines, written and read back."""
    path = scratch(s, "stats")
    n = _t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.countDistinct("l_suppkey").alias("n_keys"))
    r = degrees(s, d).join(_t(s, d, "part").select(F.col("p_partkey").alias("node"), "p_name"), "node").join(n, "node", "left")
    r.select(F.col("node").alias("id"), F.length("p_name").alias("len"), F.coalesce("n_keys", F.lit(0)).alias("n_keys"), "n_in", "n_out", "p_name").write.option("sep", "\t").csv(path)
    return s.read.option("sep", "\t").schema("id long, len long, n_keys long, n_in long, n_out long, p_name string").csv(path)


def matrix_market(s, d):
    """Part by supplier as a coordinate pattern matrix: banner, sizes and 1-based places of the entries."""
    e = stored(_t(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), "entries")
    rows, cols = (ordinals(e.select(c).distinct(), [c], "i", 1).select(c, "i") for c in ("l_partkey", "l_suppkey"))
    at = e.join(rows.withColumnRenamed("i", "r"), "l_partkey").join(cols.withColumnRenamed("i", "c"), "l_suppkey")
    size = e.agg(F.concat_ws(" ", F.countDistinct("l_partkey"), F.countDistinct("l_suppkey"), F.count("*")).alias("line"))
    head = s.range(1).select(F.lit("%%MatrixMarket matrix coordinate pattern general").alias("line"))
    return head.unionAll(size).unionAll(at.select(F.concat_ws(" ", "r", "c").alias("line")))


def dot_lines(s, d):
    e = _weighted(s, d).select(F.format_string("  %d -> %d [weight=%d];", "u", "v", F.col("q").cast("long")).alias("line"))
    return s.range(1).select(F.explode(F.array(F.lit("digraph G {"), F.lit("}"))).alias("line")).unionAll(e)


def _chain_of(s, d):
    return connected_components(_chains(s, d), "u", "v")


def quotient_graph(s, d):
    """The graph of chains: each node by its chain (or itself), edges between different ones, with how many there are."""
    e, c = _edges(s, d), stored(_chain_of(s, d), "chains")
    r = e.join(c.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(c.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    r = r.select(F.coalesce("cu", "u").alias("a"), F.coalesce("cv", "v").alias("b")).where("a <> b")
    return r.groupBy("a", "b").agg(F.count("*").alias("n"))


def zero_components(s, d):
    """Components none of whose parts was ever returned at a discount of 10 % in a lot of 45 or more."""
    c = connected_components(_edges(s, d), "u", "v")
    back = _t(s, d, "lineitem").where("l_returnflag = 'R' and l_discount > 0.095 and l_quantity >= 45").select(F.col("l_partkey").alias("node")).distinct().withColumn("back", F.lit(1))
    return c.join(back, "node", "left").groupBy("component").agg(F.count("*").alias("n"), F.coalesce(F.sum("back"), F.lit(0)).alias("weight")).where("weight = 0").select("component", "n")


def bubble_arms(s, d, least=20.0, ratio=2.0):
    """Arms of bubbles (two-step paths u > m > w with other ones of the same ends): deleted below ``least`` where the best has ``ratio`` times as much."""
    e = _weighted(s, d)
    p = e.select("u", F.col("v").alias("m"), F.col("q").alias("q1")).join(e.select(F.col("u").alias("m"), F.col("v").alias("w"), F.col("q").alias("q2")), "m").where("u <> w")
    p = p.withColumn("q", F.least("q1", "q2"))
    best = p.groupBy("u", "w").agg(F.max("q").alias("best"), F.count("*").alias("arms")).where("arms > 1")
    return p.join(best, ["u", "w"]).select("u", "m", "w", "q", ((F.col("q") < least) & (F.col("best") >= ratio * F.col("q"))).alias("deleted"))


def pair_support(s, d):
    """Suppliers of both ends of each edge."""
    k = _t(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    r = _edges(s, d).join(k.select(F.col("l_partkey").alias("u"), "l_suppkey"), "u").join(k.select(F.col("l_partkey").alias("v"), "l_suppkey"), ["v", "l_suppkey"])
    return r.groupBy("u", "v").agg(F.count("*").alias("n"))


def path_counts(s, d):
    """How often three parts follow each other in orders."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    r = _t(s, d, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"), F.lead("l_partkey", 2).over(w).alias("c")).where("c is not null")
    return r.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


QUERIES = {
    "quotient_graph": quotient_graph,
    "zero_components": zero_components,
    "bubble_arms": bubble_arms,
    "pair_support": pair_support,
    "path_counts": path_counts,
    "leftmost_right": lambda s, d: _weighted(s, d).groupBy("u").agg(F.min(F.struct("q", "v")).alias("x")).select("u", F.col("x.v").alias("v"), F.col("x.q").alias("q")),
    "component_keys": lambda s, d: connected_components(_edges(s, d), "u", "v").join(_t(s, d, "lineitem").select(F.col("l_partkey").alias("node"), "l_suppkey"), "node").select("component", "l_suppkey").distinct().groupBy("component").agg(F.count("*").alias("n")),
    "strong_components": lambda s, d: G.strong_components(stored(_edges(s, d), "edges")),
    "cyclic_core": lambda s, d: G.cyclic_core(_edges(s, d)),
    "transitive_closure": lambda s, d: G.reachable(_chains(s, d), "u", "v"),
    "bounded_paths": lambda s, d: (lambda e: G.paths_within(e, _root(e), 4))(stored(_edges(s, d), "edges")).select(F.array_join("path", ">").alias("path")),
    "bounded_distance": lambda s, d: (lambda e: G.distances_within(e, _root(e), 14.0))(stored(_edges(s, d).withColumn("w", (1 + F.col("u") % 3).cast("double")), "edges")).select("root", "node", "dist"),
    "small_components": small_components,
    "simple_hangs": simple_hangs,
    "weak_edges": weak_edges,
    "identical_edges": lambda s, d: _uses(s, d).groupBy("u", "v", "l_suppkey").agg(F.count("*").alias("merged"), F.max("l_quantity").alias("q")),
    "edge_multiplicity": lambda s, d: _uses(s, d).groupBy("u", "v").agg(F.count("*").alias("n")),
    "graph_validation": validation,
    "graph_checksum": lambda s, d: _edges(s, d).agg(F.sum((F.col("u") + 1) * (F.col("u") + 1) % 1000003 * (F.col("v") + 1)).alias("sum"), F.count("*").alias("n")),
    "graph_summary": lambda s, d: degrees(s, d).join(_t(s, d, "part").select(F.col("p_partkey").alias("node"), "p_size"), "node").groupBy(F.least(F.floor(F.col("p_size") / 10), F.lit(3)).cast("long").alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("size"), F.round(F.avg(F.col("n_in") + F.col("n_out")), 6).alias("ways")),
    "graph_fasta": graph_fasta,
    "graph_tsv": graph_tsv,
    "matrix_market": matrix_market,
    "dot_lines": dot_lines,
}

_U = "us AS (SELECT * FROM (SELECT l_partkey AS u, lead(l_partkey) OVER w AS v, l_quantity, l_suppkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) WHERE v IS NOT NULL AND u <> v)"
_WE = "we AS (SELECT u, v, max(l_quantity) AS q FROM us JOIN e USING (u, v) GROUP BY 1, 2)"
_DIR = "r AS (SELECT u AS a, v AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)"
ORACLE_SQL = {
    "quotient_graph": f"""WITH RECURSIVE {_G}, c AS (SELECT u, v FROM e JOIN g x ON x.node = u JOIN g y ON y.node = v WHERE x.n_out = 1 AND y.n_in = 1), {_REACH}
SELECT coalesce(p.component, u) AS a, coalesce(q.component, v) AS b, count(*) AS n FROM e LEFT JOIN k p ON p.node = u LEFT JOIN k q ON q.node = v WHERE coalesce(p.component, u) <> coalesce(q.component, v) GROUP BY 1, 2""",
    "zero_components": f"""WITH RECURSIVE {_G}, c AS (SELECT u, v FROM e), {_REACH} SELECT component, count(*) AS n FROM k GROUP BY 1
HAVING count(*) FILTER (node IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.095 AND l_quantity >= 45)) = 0""",
    "bubble_arms": f"""WITH {_G}, {_U}, {_WE}, p AS (SELECT x.u, x.v AS m, y.v AS w, least(x.q, y.q) AS q FROM we x JOIN we y ON x.v = y.u WHERE x.u <> y.v),
b AS (SELECT *, max(q) OVER a AS best, count(*) OVER a AS arms FROM p WINDOW a AS (PARTITION BY u, w)) SELECT u, m, w, q, q < 20 AND best >= 2 * q AS deleted FROM b WHERE arms > 1""",
    "pair_support": f"WITH {_G}, s AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS k FROM lineitem) SELECT u, v, count(*) AS n FROM e JOIN s x ON x.p = u JOIN s y ON y.p = v AND x.k = y.k GROUP BY 1, 2",
    "path_counts": "SELECT a, b, c, count(*) AS n FROM (SELECT l_partkey AS a, lead(l_partkey) OVER w AS b, lead(l_partkey, 2) OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) WHERE c IS NOT NULL GROUP BY 1, 2, 3",
    "leftmost_right": f"WITH {_G}, {_U}, {_WE} SELECT u, v, q FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY q, v) AS i FROM we) WHERE i = 1",
    "component_keys": f"WITH RECURSIVE {_G}, c AS (SELECT u, v FROM e), {_REACH} SELECT component, count(DISTINCT l_suppkey) AS n FROM k JOIN lineitem ON l_partkey = node GROUP BY 1",
    "strong_components": f"WITH RECURSIVE {_G}, {_DIR} SELECT g.node, least(g.node, coalesce(min(x.b), g.node)) AS component FROM g LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON r.a = q.b AND r.b = q.a) x ON x.a = g.node GROUP BY g.node",
    "cyclic_core": f"""WITH RECURSIVE {_G}, {_DIR}, c AS (SELECT a FROM r WHERE a = b), f AS (SELECT b AS x FROM r WHERE a IN (SELECT a FROM c)), k AS (SELECT a AS x FROM r WHERE b IN (SELECT a FROM c))
SELECT u, v FROM e WHERE u IN (SELECT x FROM f) AND v IN (SELECT x FROM k)""",
    "transitive_closure": f"""WITH RECURSIVE {_G}, c AS (SELECT u, v FROM e JOIN g x ON x.node = u JOIN g y ON y.node = v WHERE x.n_out = 1 AND y.n_in = 1),
r AS (SELECT u, v FROM c UNION SELECT r.u, c.v FROM r JOIN c ON r.v = c.u) SELECT u, v FROM r""",
    "bounded_paths": f"""WITH RECURSIVE {_G}, p AS (SELECT [min(u)] AS path, 0 AS n FROM e UNION ALL SELECT list_append(path, v), n + 1 FROM p JOIN e ON path[-1] = u WHERE n < 4 AND NOT list_contains(path, v))
SELECT array_to_string(path, '>') AS path FROM p WHERE n > 0""",
    "bounded_distance": f"""WITH RECURSIVE {_G}, m AS (SELECT min(u) AS root FROM e), w AS (SELECT root AS node, 0 AS dist FROM m UNION SELECT v, dist + 1 + u % 3 FROM w JOIN e ON node = u WHERE dist + 1 + u % 3 <= 14)
SELECT root, node, min(dist)::DOUBLE AS dist FROM w, m GROUP BY 1, 2""",
    "small_components": f"WITH RECURSIVE {_G}, c AS (SELECT u, v FROM e), {_REACH}, z AS (SELECT component, count(*) AS n FROM e JOIN k ON node = u GROUP BY 1) SELECT u, v FROM e JOIN k ON node = u JOIN z USING (component) WHERE n >= 5",
    "simple_hangs": f"WITH {_G}, {_U}, {_WE}, b AS (SELECT u, max(q) AS best FROM we GROUP BY 1) SELECT we.u, we.v, q, best FROM we JOIN b ON b.u = we.u JOIN g ON g.node = we.v WHERE n_out = 0 AND n_in = 1 AND q < best",
    "weak_edges": f"WITH {_G}, {_U}, {_WE} SELECT u, v, q, NOT (q <= 15 AND max(q) OVER (PARTITION BY u) >= 3 * greatest(1, q)) AS kept FROM we",
    "identical_edges": f"WITH {_U} SELECT u, v, l_suppkey, count(*) AS merged, max(l_quantity) AS q FROM us GROUP BY 1, 2, 3",
    "edge_multiplicity": f"WITH {_U} SELECT u, v, count(*) AS n FROM us GROUP BY 1, 2",
    "graph_validation": f"""WITH {_G} SELECT 'self loop' AS rule, count(*) AS n FROM e WHERE u = v UNION ALL SELECT 'missing end', count(*) FROM e WHERE u IS NULL OR v IS NULL
UNION ALL SELECT 'edge twice', count(*) FROM (SELECT u, v FROM e GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'degrees differ', count(*) FROM (SELECT sum(n_in) AS i, sum(n_out) AS o FROM g) WHERE i <> o
UNION ALL SELECT 'no such part', count(*) FROM e WHERE u NOT IN (SELECT p_partkey FROM part)""",
    "graph_checksum": f"WITH {_G} SELECT sum((u + 1) * (u + 1) % 1000003 * (v + 1))::BIGINT AS sum, count(*) AS n FROM e",
    "graph_summary": f"WITH {_G} SELECT least(p_size // 10, 3)::BIGINT AS bucket, count(*) AS n, sum(p_size)::BIGINT AS size, round(avg(n_in + n_out), 6) AS ways FROM g JOIN part ON p_partkey = node GROUP BY 1",
    "graph_fasta": f"WITH {_G} SELECT node AS id, p_name AS seq FROM g JOIN part ON p_partkey = node",
    "graph_tsv": f"WITH {_G}, n AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT node AS id, length(p_name) AS len, coalesce(n, 0) AS n_keys, n_in, n_out, p_name FROM g JOIN part ON p_partkey = node LEFT JOIN n ON l_partkey = node",
    "matrix_market": """WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS q FROM lineitem) SELECT '%%MatrixMarket matrix coordinate pattern general' AS line
UNION ALL SELECT count(DISTINCT p) || ' ' || count(DISTINCT q) || ' ' || count(*) FROM e UNION ALL SELECT dense_rank() OVER (ORDER BY p) || ' ' || dense_rank() OVER (ORDER BY q) FROM e""",
    "dot_lines": f"WITH {_G}, {_U}, {_WE} SELECT 'digraph G {{' AS line UNION ALL SELECT '}}' UNION ALL SELECT format('  {{}} -> {{}} [weight={{}}];', u, v, q::BIGINT) FROM we",
}
