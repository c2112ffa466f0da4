"""The corpus queries that SQL can express, against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from docflow.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    expected = sorted((tuple(r[found.columns.index(c)] for c in order) for r in found.fetchall()), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))
