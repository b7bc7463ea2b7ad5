"""Every query against its SQL, on small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns, values = rows(got.columns, [tuple(r) for r in got.collect()])
    assert values or name in ("verify_probes",)
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        names, expected = rows(want.columns, want.fetchall())
        assert columns == names
        assert len(values) == len(expected)
        for a, b in zip(values, expected):
            assert a == b, (columns, a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
