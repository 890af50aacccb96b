"""Every registered query of the library equals its SQL on the smallest data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexloom import queries as own

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-9 * max(1, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query(spark, db, name):
    got = own.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({own.ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert len(rows) == len(want)
    assert all(_same(x, y) for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(own.QUERIES) == set(own.ORACLES)
