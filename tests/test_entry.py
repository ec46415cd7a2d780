"""The driver's entry points, and some queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["op_rank", "op_sma", "alpha002", "alpha029", "alpha174", "quintile_returns", "xs_metrics", "membership_daily", "purged_folds", "permutation_importance", "exchange_mix"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"alpha{i:03d}" for i in range(1, 192)} <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    names = sorted(want.columns)
    rows = sorted(map(str, want.select(*names).fetchall()))
    got = sorted(map(str, map(tuple, entry.queries()[name](spark, SF).select(*names).collect())))
    assert got == rows
