"""Every graph query against its SQL at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from weftgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)

    return sorted(columns), sorted((tuple(one(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(catalog.SQL[name])
    assert found == canonical(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1
