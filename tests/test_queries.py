"""Every registered query against its SQL twin."""

import datetime
import math
import os

import pytest

import __spark_entry__ as entry_points
from rowmill.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, twin, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = df.collect()
    cursor = twin.execute(catalogue.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert _sorted(got, df.columns) == _sorted(want, columns)


def test_entry(spark):
    rows = {(r["check"], r["subject"]): r["value"] for r in entry_points.entry(spark).collect()}
    assert rows[("lost rows", "sales")] == 0 and rows[("rows", "sales")] > 0
    assert all(v == 0 for (check, _), v in rows.items() if check in ("orphans", "key violations"))
