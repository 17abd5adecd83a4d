"""The queries of this package against their SQL twins."""

import math
from pathlib import Path

import duckdb
import pytest
import xxhash

from tallyspark.llm import oracles, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def value(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(name, spark, duck, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    answer = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted((tuple(value(r[i]) for i in order) for r in answer.fetchall()), key=repr)


def test_xxh64_in_sql():
    texts = ["", "a", "abc", "abcd", "abcdefgh", "x" * 31, "y" * 32, "é" * 20, "z" * 101, *("ab ç" * n for n in range(40))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(t,) for t in texts])
    steps = ", ".join(oracles._xxh64(42))
    found = con.execute(f"WITH s0 AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM t), {steps} SELECT s, h FROM hashed").fetchall()
    assert len(found) == len(texts) and all(h == xxhash.xxh64_intdigest(s.encode(), 42) for s, h in found)
