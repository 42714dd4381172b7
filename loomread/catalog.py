"""The library's queries on the given tables, by name, with their SQL."""

from __future__ import annotations

from loomread.plans import graphs, intake, keys, kmers, loci, measures, quality, relations, stats

FAMILIES = [kmers, stats, keys, relations, quality, loci, measures, graphs, intake]
QUERIES = {k: v for f in FAMILIES for k, v in f.QUERIES.items()}
ORACLE_SQL = {k: v for f in FAMILIES for k, v in f.ORACLE_SQL.items()}
