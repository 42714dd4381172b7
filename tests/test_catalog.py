"""Every query of the library against its SQL on the smallest tables."""

import glob
import math

import duckdb
import pytest

from loomread import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return int(v) if v == int(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_names_agree():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    key = lambda rows: sorted((tuple(map(_plain, r)) for r in rows), key=repr)
    assert key(got) == key(want)
    assert glob.glob(f"{SF}/*.parquet")
