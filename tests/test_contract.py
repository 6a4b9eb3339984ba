"""The entry module: names, SQL for known queries, and a run of a few of them against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


NAMES = "a1_summary a3_daily w1_pairs v1_nearest r13_select j7_descendants t14_rows z4_daily_stream t6_demoted t11_headers t22_markdown s21_boxes b2_spaced b4_masked h2_segments h9_keys r5_ranges q9_composed i6_fallback i13_dense o6_full a13_slots t24_values t26_leading a24_headers"


@pytest.mark.parametrize("name", NAMES.split())
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations", "embeddings", "part", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    form = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(form, cur.fetchall()))) == sorted(map(repr, map(form, got.select(*columns).collect())))
