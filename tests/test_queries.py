"""Every registered query that has SQL gives the SQL's rows, at the smallest scale."""

import math

import duckdb
import pytest

from quillgraph.plans import registry
from quillgraph.sources.tables import TABLES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, sf, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    got = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
    assert ours == theirs
    assert ours or name == "mirror_block_remap", "a query without rows shows nothing"  # no mirrored text at this scale


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:3] == ["query_id", "id", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
