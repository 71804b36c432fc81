"""Holds a query's rows against those of its SQL in DuckDB."""

import math
import os
from collections import Counter
from datetime import date, datetime
from pathlib import Path

DATA = Path(os.environ.get("HANDBILL_TEST_DATA", "/root/testdata/sf0.001"))


def value(x):
    """A value that is equal in both engines: rounded numbers, times as text, lists as tuples."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (datetime, date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, int):
        return float(f"{float(x):.9g}") if abs(x) > 1 << 53 else x
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(value(r[i]) for i in order) for r in found)


def by_duckdb(sql, data=DATA):
    import duckdb

    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for p in data.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        return names, cursor.fetchall()


def assert_same(df, sql, data=DATA):
    names, expected = by_duckdb(sql, data)
    assert sorted(df.columns) == sorted(names)
    want, got = rows(names, expected), rows(df.columns, [tuple(r) for r in df.collect()])
    missing, surplus = want - got, got - want
    assert not missing and not surplus, (f"{missing.total()} rows of {want.total()} missing, {surplus.total()} too many", list(missing)[:2], list(surplus)[:2])
    return want.total()
