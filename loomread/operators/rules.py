"""Alerts: threshold rules over metrics, and suppression by raised parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.operators.graphs import reachable


def raised(compare: Column, value: Column, threshold: Column) -> Column:
    """(compare is '>') differs from (value < threshold): equality raises '>' rules only; null values raise nothing."""
    return F.coalesce((compare == ">") != (value < threshold), F.lit(False))


def evaluate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(stage, name, metric, action, parent, value, raised): each rule on each stage's metric; a missing metric raises nothing."""
    j = rules.join(metrics, "metric", "left")
    return j.select("stage", "name", "metric", "action", "parent", "value", raised(F.col("compare"), F.col("value"), F.col("threshold")).alias("raised"))


def suppress(alerts: DataFrame) -> DataFrame:
    """Raised alerts of which no ancestor is raised on the same stage; in a cycle of parents an alert is not its own ancestor."""
    up = alerts.where("raised").select("stage", F.col("name").alias("anc"))
    parents = alerts.select("name", F.col("parent").alias("anc")).where("anc is not null").distinct()
    chain = reachable(parents, "name", "anc").where("name <> anc")
    under = chain.join(up, "anc").select("stage", "name").distinct()
    return alerts.where("raised").join(under, ["stage", "name"], "left_anti")
