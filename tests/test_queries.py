"""Every registered query of the library against its SQL twin in DuckDB."""

import math
import os
import pathlib

import duckdb
import pytest

from tracekit.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(a, b):
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) or isinstance(b, float) or hasattr(a, "as_tuple") or hasattr(b, "as_tuple"):
        if a is None or b is None:
            return a is b
        return math.isnan(a) and math.isnan(b) or math.isclose(float(a), float(b), rel_tol=1e-8, abs_tol=1e-12)
    return a == b


def in_order(rows):
    """By what is no rounded number first: two rows that differ only in the last digits of a double may swap otherwise."""
    loose = lambda v: isinstance(v, float) or hasattr(v, "as_tuple")
    return sorted(rows, key=lambda r: (tuple(repr(v) for v in r if not loose(v)), tuple(float(v) for v in r if loose(v))))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    want = in_order([tuple(r[theirs.index(c)] for c in columns) for r in found.fetchall()])
    got = in_order([tuple(r[c] for c in columns) for r in rows])
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if not same(a, b)] == []
