"""Every registered query against its oracle, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from seqlens.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NO_SQL = {"a13k_shares", "a15k_tree"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else int(value) if value.is_integer() else float(f"{value:.12g}")
    return value if value is None or isinstance(value, (str, bool, int)) else plain(float(value))


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    if name in NO_SQL:
        assert rows and name not in ORACLES
        return
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert table(rows, found.columns) == table(want.fetchall(), columns)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
