"""Each query of the core with SQL gives what DuckDB gives over the same tables."""

import math

import pytest

from quillmere.plans import registry

duckdb = pytest.importorskip("duckdb")


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return str(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def _rows(rows, columns, order):
    return sorted(tuple(_plain(r[order.index(c)]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def con(tiny):
    from pathlib import Path

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(tiny).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, tiny, con, name):
    df = registry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    answer = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert _rows([tuple(r) for r in df.collect()], columns, df.columns) == _rows(answer.fetchall(), columns, names)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, tiny, name):
    assert registry.queries()[name](spark, tiny).count() > 0
