"""Every query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import datetime
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        made.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


def plain(v):
    """A value as both engines print it."""
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0) if type(v).__name__ == "Decimal" else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert ours == theirs, f"{columns}\nonly here: {list((ours - theirs).items())[:5]}\nonly there: {list((theirs - ours).items())[:5]}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
