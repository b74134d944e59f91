"""Registered queries against their DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

FOLDER = os.environ.get("PANELCAST_TEST_TABLES", "/root/testdata/sf0.001")


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return None if math.isnan(number) else round(number, 6)


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def same_as_sql(spark, name, folder=FOLDER):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(map(_plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    asked = sorted((tuple(map(_plain, r)) for r in want.fetchall()), key=_key)
    assert len(rows) == len(asked) > 0
    for a, b in zip(rows, asked):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["assay_pivot_baseline", "assay_pivot_lod"])
def test_assay_pivots(spark, name):
    same_as_sql(spark, name)
