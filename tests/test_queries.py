"""Every registered core query against its SQL twin, and against itself where there is none."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tallyspark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_sql(name, spark, duck, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    answer = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_are_repeatable(name, spark, sf_dir):
    first, again = (sorted(map(tuple, catalog.QUERIES[name](spark, sf_dir).collect()), key=repr) for _ in range(2))
    assert first == again and first


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "total_ms" in out.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
