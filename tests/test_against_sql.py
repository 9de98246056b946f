"""Every checked query that needs no calibration run, against DuckDB on the smallest tables."""

import duckdb
import pytest

import checks

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
# The calibrated chain is covered by test_energy on the tables its golden values were made for.
SLOW = ("i01", "i02", "a08", "b07", "b08", "b12_scene", "e05_cal", "e07_et")
NAMES = [n for n in checks.SQL if not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = checks.QUERIES[name](spark, PATH)
    cols = sorted(df.columns)
    cur = duck.execute(checks.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(repr(r[i]) for i in at) for r in cur.fetchall())
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
