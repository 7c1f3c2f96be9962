"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os
import re

import duckdb
import pandas as pd
import pytest

from tickloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or "bool" in type(v).__name__:
        return bool(v)
    return str(v) if isinstance(v, str) else float(v)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert len([n for n in e.queries() if not re.match(r"op\d|pipeline", n)]) >= 110


def test_newest_ticks_of_one_second(spark, duck, tmp_path):
    """Scans of bronze ticks follow their SQL where many ticks share a second."""
    duck.execute(f"""create or replace temp table crowd as select i as event_id, timestamp '2024-01-30 23:59:00' + interval 1 microsecond * (i * 7919 % 1000 * 997) as ts,
        i as user_id, if(i % 2 = 0, 'click', 'view') as event_type, i + 0.5 as value, '{{"k": 90}}' as props from range(400) r(i)""")
    duck.execute(f"copy crowd to '{tmp_path}/events.parquet'")
    own = duckdb.connect()
    own.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    for name in ("latest_ticks", "scan_predicate"):
        got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), own.execute(registry.oracle_sql()[name]).fetchdf()
        assert list(got["seq"]) == list(want["seq"]) and len(got) == 50
