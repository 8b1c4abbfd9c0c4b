"""Every registered query of the panel engine against its SQL twin, on the smallest tables."""

import math
from datetime import datetime

import pytest
from tests_support import SF_SMALL

from lodepanel.plans import registry

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, sql, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    there = sql.execute(registry.ORACLES[name])
    columns = [c[0] for c in there.description]
    assert sorted(df.columns) == sorted(columns)
    ours, theirs = table(df.collect(), df.columns), table(there.fetchall(), columns)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-5, rel=1e-6)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_is_sound(spark, name):
    """Their values are held against plain computations elsewhere; here: rows, no empty column, and the same again."""
    df = registry.QUERIES[name](spark, SF_SMALL)
    once = table(df.collect(), df.columns)
    assert once and all(any(row[i] is not None for row in once) for i in range(len(df.columns)))
    assert table(registry.QUERIES[name](spark, SF_SMALL).collect(), df.columns) == once
