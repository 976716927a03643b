"""Every query with SQL gives the same rows in DuckDB; those without run and have rows of a stable schema."""

import datetime
import math

import duckdb
import pytest

from paperloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(cols, data, names):
    at = [cols.index(n) for n in names]
    return sorted((tuple(plain(r[k]) for k in at) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rel = con.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()], names), rows(list(rel.columns), rel.fetchall(), names)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, (int, float)) and math.isclose(x, float(y), rel_tol=1e-9), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and len(df.take(5)) >= 0


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_folder(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE)
