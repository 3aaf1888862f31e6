"""Every registered query with SQL gives the same rows in Spark and DuckDB."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry_points.queries()[name](spark, str(FOLDER))
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(row[names.index(c)]) for c in df.columns]) for row in cursor.fetchall())
    have = sorted(repr([plain(v) for v in row]) for row in df.collect())
    assert have == want


def test_registries_agree():
    assert set(SQL) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert entry_points.queries()[name](spark, str(FOLDER)).count() > 0
