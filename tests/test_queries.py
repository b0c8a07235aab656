"""Every registered query against its SQL in DuckDB, over the smallest tables: names, types and rows."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

from juristream.plans import registry

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert rows or name == "set_except"
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["node", "parent"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir("/root/testdata/sf0.001")
