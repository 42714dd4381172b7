"""Rounds of joins over directed edges (u, v): reachability, distances, strong components, peeling, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.storage import stored


FEW = 20_000  # rows of a frontier that are broadcast


def _step(front: DataFrame, n: int, edges: DataFrame) -> DataFrame:
    """The ``n`` rows of ``front`` (node, ...) with the edges out of their nodes; only a counted small frontier goes through the driver.

    Spark would broadcast by the compressed size of files, and so also edges and nodes that are many times as large in memory, in every
    round; other joins of rounds with more than FEW rows are hinted to merge for that reason.
    """
    return (F.broadcast(front) if n <= FEW else front.hint("merge")).join(edges, F.col("node") == F.col("u"))


def _met(df: DataFrame, n: int) -> DataFrame:
    """``df`` as a side of a join, of ``n`` rows at most: merged with, unless it is small."""
    return df if n <= FEW else df.hint("merge")


def breadth_first(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of every node that ``roots`` (node) reach; a round joins the frontier with the edges and leaves out seen nodes."""
    seen = front = stored(roots.select("node", F.lit(0).alias("depth")).distinct(), "front")
    depth = total = 0
    while n := front.count():
        depth, total = depth + 1, total + n
        step = _step(front, n, edges).select(F.col("v").alias("node")).distinct()
        front = stored(step.join(_met(seen.select("node"), total), "node", "left_anti").select("node", F.lit(depth).alias("depth")), "front")
        seen = seen.unionAll(front)
    return seen


def reachable(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst): the transitive closure, by doubling: each round joins the paths found so far with themselves, until none is new.

    Its size may be the square of the nodes', so it is meant for small or shallow relations, such as parents.
    """
    paths = stored(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "closure")
    n = paths.count()
    while n:
        longer = paths.join(paths.select(F.col("u").alias("v"), F.col("v").alias("w")).hint("merge"), "v").select("u", F.col("w").alias("v"))
        paths = stored(paths.union(longer).distinct(), "closure")
        before, n = n, paths.count()
        if n == before:
            break
    return paths.select(F.col("u").alias(src), F.col("v").alias(dst))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without a way in or without a way out are peeled off until there are none."""
    cur = stored(edges.select("u", "v").distinct(), "core")
    n = cur.count()
    while n:
        cur = stored(cur.join(_met(cur.select(F.col("v").alias("u")).distinct(), n), "u", "left_semi").join(_met(cur.select(F.col("u").alias("v")).distinct(), n), "v", "left_semi").select("u", "v"), "core")
        before, n = n, cur.count()
        if n == before:
            break
    return cur


def _least_forward(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, color): the least node that reaches it, itself included, over the edges; labels travel until none changes."""
    color = stored(nodes.select("node", F.col("node").alias("color")), "color")
    moved, every = color, color.count()
    while n := moved.count():
        # only labels that changed travel on
        sent = _step(moved, n, edges).groupBy(F.col("v").alias("node")).agg(F.min("color").alias("sent"))
        new = color.join(_met(sent, every), "node", "left").select("node", F.least("color", F.coalesce("sent", "color")).alias("color"), (F.col("sent") < F.col("color")).alias("changed"))
        new = stored(new, "color")
        moved, color = new.where("changed").select("node", "color"), new.select("node", "color")
    return color


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of all nodes, each named by its least node.

    Nodes outside the cyclic core are components of their own. In the core, each node takes the least node that reaches
    it as its color; the nodes of a color that also reach its root are the root's component. They are taken out, and
    the rest starts again with its core.
    """
    e = edges.select("u", "v").where("u is not null and v is not null").distinct()
    nodes = stored(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "nodes")
    found = []
    core = cyclic_core(e.where("u <> v"))
    while not core.isEmpty():
        inside = core.select(F.col("u").alias("node")).union(core.select("v")).distinct()
        color = _least_forward(core, inside)
        tinted = core.join(color.select(F.col("node").alias("u"), F.col("color").alias("cu")).hint("merge"), "u").join(color.select(F.col("node").alias("v"), F.col("color").alias("cv")).hint("merge"), "v")
        back = stored(tinted.where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v")), "back")
        reached = breadth_first(back, color.where("node = color").select("node")).select("node")
        part = stored(color.join(reached.hint("merge"), "node", "left_semi").select("node", F.col("color").alias("component")), "strong")
        found.append(part)
        rest = core.join(part.select(F.col("node").alias("u")).hint("merge"), "u", "left_anti").join(part.select(F.col("node").alias("v")).hint("merge"), "v", "left_anti")
        core = cyclic_core(rest.select("u", "v"))
    named = nodes.select("node", F.lit(None).cast("long").alias("component")).limit(0)
    for f in found:
        named = named.unionByName(f)
    return nodes.join(named.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def distances_within(edges: DataFrame, roots: DataFrame, bound: Column | float, weight: str = "w") -> DataFrame:
    """(root, node, dist): least summed weight of paths from each root, up to ``bound``; weights are above 0. Relaxed until nothing gets shorter."""
    limit = bound if isinstance(bound, Column) else F.lit(bound)
    best = stored(roots.select(F.col("node").alias("root"), "node", F.lit(0.0).alias("dist")).distinct(), "dist")
    moved = best
    while n := moved.count():
        step = _step(moved, n, edges).select("root", F.col("v").alias("node"), (F.col("dist") + F.col(weight)).alias("dist")).where(F.col("dist") <= limit)
        step = step.groupBy("root", "node").agg(F.min("dist").alias("d"))
        new = stored(best.join(step, ["root", "node"], "full").select("root", "node", F.least("dist", "d").alias("dist"), F.coalesce(F.col("d") < F.col("dist"), F.col("dist").isNull()).alias("changed")), "dist")
        moved, best = new.where("changed").select("root", "node", "dist"), new.select("root", "node", "dist")
    return best


def paths_within(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(path): every path without a repeated node of 1 to ``hops`` edges from the roots, as an array of nodes."""
    front = roots.select(F.array("node").alias("path"))
    out = None
    for _ in range(hops):
        front = stored(front.withColumn("u", F.element_at("path", -1)).join(edges.select("u", "v"), "u").where(~F.array_contains("path", F.col("v"))).select(F.concat("path", F.array("v")).alias("path")), "paths")
        out = front if out is None else out.unionAll(front)
    return out
