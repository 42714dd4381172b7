"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.storage import stored


def _state(edges: DataFrame):
    """Count and hash sum of the edges, which tell whether a round has changed them."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node that ``edges`` names; component is the smallest reachable node.

    Each round is two joins-free aggregations over the edges and halves the depth of the trees, so the number of
    rounds is logarithmic; a round's edges are written to the shared folder to cut lineage. Rows with a null end and
    self loops link nothing (a self loop still names its node). An empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    named = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")  # edges may be dear: they are made once
    nodes = named.select("u").union(named.select("v")).distinct()
    cur = named.where("u <> v")
    state = _state(cur)
    for _ in range(max_rounds):
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stored(small.where("u <> v").distinct(), "star")
        before, state, cur = state, _state(new), new
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = cur.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.withColumnRenamed("u", "node").join(label.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
