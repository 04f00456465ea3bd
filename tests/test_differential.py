"""Every registered query with SQL gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from lamellar.plans import connector_queries as _  # registers its queries
from lamellar.plans import queries


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows_equal(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    got = df.collect()
    if name not in queries.ORACLES:
        assert got
        return
    cur = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_cross_join_and_pushdown(spark, small):
    plan = lambda n: queries.QUERIES[n](spark, small)._jdf.queryExecution().toString()
    for name in queries.QUERIES:
        if name not in ("schema_discovery", "linear_probe", "tile_encode_pool", "zscore"):
            assert "CartesianProduct" not in plan(name) and "BroadcastNestedLoopJoin" not in plan(name), name
    assert "PushedFilters: [IsNotNull(p_size), GreaterThanOrEqual(p_size,40)]" in plan("projection_fields")
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size:int>" in plan("projection_fields")
