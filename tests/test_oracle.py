"""Every registered query against its DuckDB oracle on the smallest test
data (the driver repeats this at sf0.01)."""

import datetime as dt
import decimal

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages "
       "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in RAW:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _names():
    from fitlake.plans.registry import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_matches_oracle(spark, con, name):
    from fitlake.plans.registry import oracle_sql, queries
    df = queries()[name](spark, SF)
    res = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert _rows(df.columns, df.collect()) == _rows(res.columns, res.fetchall())


def test_every_query_runs(spark):
    """Queries without an oracle (nested / streaming) still run with a stable schema."""
    from fitlake.plans.registry import oracle_sql, queries
    for name in sorted(set(queries()) - set(oracle_sql())):
        df = queries()[name](spark, SF)
        assert df.columns
        df.limit(5).collect()


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
