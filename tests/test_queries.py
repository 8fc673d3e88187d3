"""Every registered query against its SQL twin on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def cells(rows):
    return sorted(tuple(map(repr, row)) for row in rows)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in contract.oracle_sql():
        assert ours
        return
    found = duck.execute(contract.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in found.description}
    order = list(kinds)
    theirs = [tuple(row[order.index(c)] for c in columns) for row in found.fetchall()]
    assert columns == sorted(kinds)
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    assert cells(ours) == cells(theirs)


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
