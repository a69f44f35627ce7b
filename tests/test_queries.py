"""Every core query at the smallest scale against its SQL, and the contract of the registry."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracegrove.plans import CORE_ORACLES, CORE_QUERIES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def test_registry(spark, data):
    assert set(CORE_ORACLES) <= set(CORE_QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["ref_table", "ref_key", "ref_field"]


@pytest.mark.parametrize("name", sorted(CORE_QUERIES))
def test_query(spark, data, con, name):
    df = CORE_QUERIES[name](spark, data)
    rows = df.collect()
    if name in CORE_ORACLES:
        got = con.execute(CORE_ORACLES[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in got.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == want
    spark.catalog.clearCache()
