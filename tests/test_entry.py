import duckdb
import pytest

import __spark_entry__ as entry
import check

SMALLEST = "/root/testdata/sf0.001"

# A cross-section that runs fast on the smallest tables.
QUICK = ["y1_y2_volumes", "y10_y11_pulses", "m8_best", "j6_upstream", "g1_interpolate", "v5_climatology_by_lead"]


def test_every_oracle_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(sql) > 90


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "Qann_slp" in df.columns and df.count() >= 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALLEST)
    cols = sorted(df.columns)
    got = sorted((tuple(check.canon(r[c]) for c in cols) for r in df.collect()), key=check.key)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(check.canon(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=check.key)
    assert sorted(names) == cols and [check.key(r) for r in got] == [check.key(r) for r in want]
