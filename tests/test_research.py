"""Backtests and splits against values worked out by hand, and invariants."""

import datetime as dt
import random
import re

import pytest

from factorlab import research_queries as RQ
from factorlab.functions.expr import DELTA, RANK, WHERE, field
from factorlab.operators import evaluation as E
from factorlab.operators import portfolio as P
from factorlab.operators import screening as SC
from factorlab.operators import statistics as S
from factorlab.operators import universe as U
from factorlab.plans.planner import Plan
from factorlab.sources import bars as B

DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5)]


def test_signal_backtest_golden(spark):
    rows = list(zip(["a"] * 5, DAYS, [10.0, 11.0, 12.0, 11.0, 13.0], [0, 0, 1, 0, 0]))
    got = P.signal_backtest(spark.createDataFrame(rows, "symbol string, date date, close double, signal int")).orderBy("date").collect()
    assert [r.position for r in got] == [0, 0, 0, 1, 0]
    assert got[0].net is None and got[0].equity is None
    assert [r.net for r in got[1:]] == pytest.approx([0, 0, -0.08359333, -0.00076], abs=1e-8)
    assert [r.equity for r in got[1:]] == pytest.approx([1, 1, 0.91640667, 0.91571020], abs=1e-8)
    m = P.metrics(P.signal_backtest(spark.createDataFrame(rows, "symbol string, date date, close double, signal int")), ("symbol",)).first()
    assert m.n_trades == 2 and m.total_return == pytest.approx(-0.0842898, abs=1e-6)


def test_padded_returns(spark):
    df = spark.createDataFrame(list(zip(["a"] * 3, DAYS, [10.0, None, 20.0])), "symbol string, date date, close double")
    assert [r.ret for r in E.padded_returns(df).orderBy("date").collect()] == [None, 0.0, 1.0]
    assert [r.ret for r in E.padded_returns(df, pad=False).orderBy("date").collect()] == [None, None, None]


def test_purged_folds():
    folds = U.purged_folds(60, 5, 6)
    assert folds[0] == (0, 4, 10, 20) and folds[-1] == (4, 44, 50, 60)
    for _, end, start, stop in folds:
        assert end <= start - 6 and start < stop
    with pytest.raises(ValueError):
        U.purged_folds(9, 5)


def test_as_of(spark):
    left = spark.createDataFrame([("a", d) for d in DAYS], "symbol string, date date")
    right = spark.createDataFrame([("a", DAYS[1], 1.0), ("a", DAYS[3], 2.0)], "symbol string, effective_date date, value double")
    assert [r.value for r in U.as_of(left, right, "value").orderBy("date").collect()] == [None, 1, 1, 2, 2]
    assert [r.value for r in U.as_of(left, right, "value", back_fill=True).orderBy("date").collect()] == [1, 1, 1, 2, 2]


def test_constant_section_has_one_bin(spark):
    df = spark.createDataFrame([(i, DAYS[0], 1.0, 0.1) for i in range(20)], "symbol int, date date, score double, fwd double")
    assert {r.bin for r in E.binned(df).collect()} == {0}
    assert E.rank_ic(df).count() == 0


def test_weights_sum(spark):
    rows = [(i, d, float((i * 7 + k * 3) % 25), 1.0) for i in range(25) for k, d in enumerate(DAYS)]
    df = spark.createDataFrame(rows, "symbol int, date date, score double, close double")
    w = P.section_weights(df, P.rebalance_dates(df, "weekly"), 0.2, 0.2).groupBy("rb").sum("w").collect()
    assert w and all(abs(r["sum(w)"]) < 1e-12 for r in w)
    t = P.target_weights(df).groupBy("date").sum("target").collect()
    assert all(abs(r["sum(target)"]) < 1e-12 for r in t)


def test_random_scores_have_no_ic(spark):
    rng = random.Random(1)
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(d), rng.random(), rng.random()) for i in range(30) for d in range(100)]
    df = spark.createDataFrame(rows, "symbol int, date date, score double, fwd double")
    assert abs(E.ic_summary(E.rank_ic(df)).first().ic_mean) < 0.08


def test_greedy_pool():
    corr = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.2}
    assert E.greedy_pool([("a", 0.1), ("b", -0.5), ("c", 0.3)], corr) == ["b", "c"]
    assert E.greedy_pool([("a", 0.1), ("b", -0.5), ("c", 0.3)], corr, forced=["a"]) == ["a", "c"]


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert S.auc(df, "s", "y").first().auc == 0.75


def test_delisted(spark):
    df = spark.createDataFrame(list(zip(["a"] * 4, DAYS, [10.0, 10.0, 10.0, 10.0])), "symbol string, date date, close double")
    gone = spark.createDataFrame([("a", DAYS[2], None)], "symbol string, delist_date date, liquidation_price double")
    got = [r.ret for r in P.delisted(E.padded_returns(df), gone).orderBy("date").collect()]
    assert got[:2] == [None, 0.0] and got[2] == pytest.approx(-0.1) and got[3] is None


def test_edges_of_dates_are_broadcast(spark):
    """A date's edges are a row a date: the rows stay where they are (before: all rows were shuffled by date to meet them)."""
    df = spark.range(200).selectExpr("id AS symbol", "date_add(DATE'2020-01-01', CAST(id % 5 AS int)) AS date", "CAST(id * 7 % 31 AS double) AS score", "CAST(id * 11 % 37 AS double) AS fwd")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        for got in (E.binned(df, "score"), U.labels(df)):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and got.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_daily_groups_equal_ranks_and_quantiles(spark):
    """One grouped map a date gives what rank_ic() and quantile_returns() give; small dates have neither."""
    rows = [(s, dt.date(2020, 1, 6 + d), float((s * s * 31 + d) % (7 if d == 1 else 101)) if s % 6 else None, float((s * 7 + d * d) % 53) / 53) for d in range(4) for s in range((40, 40, 12, 9)[d])]
    df = spark.createDataFrame(rows, "symbol int, date date, score double, fwd double")
    got = {r.date: r for r in SC.daily_groups(df, {"score": "f"}).collect()}
    ic = {r.date: r.ic for r in E.rank_ic(df).collect()}
    quantiles = {r.date: tuple(r)[1:] for r in E.quantile_returns(df, "score").collect()}
    assert {d for d, r in got.items() if r.ic is not None} == set(ic) and {d for d, r in got.items() if r.sums} == set(quantiles) and len(quantiles) == 2
    for d, v in ic.items():
        assert abs(got[d].ic - v) < 1e-12
    for d, q in quantiles.items():
        for total, n, m in zip(got[d].sums, got[d].counts, q, strict=True):
            assert n == 0 and m is None or abs(total / n - m) < 1e-12


def test_scores_move_once_after_returns(spark):
    """Histories of the panel need no shuffle after the bars', and base() moves its rows once more, by date."""
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(symbol#")
    rows = [(s, dt.date(2020, 1, 6 + d), float(s + d)) for s in range(3) for d in range(4) if s != d]
    bars = spark.createDataFrame(rows, "symbol int, date date, close double")
    panel = B.panel(bars)
    assert exchanges(E.next_returns(E.padded_returns(panel))) == 1
    want = {(s, dt.date(2020, 1, 6 + d)): float(s + d) if s != d else None for s in range(3) for d in range(4)}
    assert {(r.symbol, r.date): r.close for r in panel.collect()} == want


def test_section_groups_equal_planned_scores(spark):
    """Scores taken in a date's group equal the planner's, and gaps stay unknown, also for a score that is known where nothing is."""
    rows = [(s, dt.date(2020, 1, 6 + d), *(float((s * s * k + d * d * s) % 23) if (s + d) % 5 else None for k in (3, 7, 11)), float((s * 7 + d) % 53) / 53) for d in range(14) for s in range(40 if d else 12)]
    panel = spark.createDataFrame(rows, "symbol int, date date, open double, close double, volume double, fwd double")
    close = field("close")
    for roots in (RQ._ROOTS, RQ._ROOTS | {"odd": WHERE(RANK(DELTA(close, 1)) < 0.5, 1.0, RANK(close))}):
        names = {k: k for k in roots}
        rows_of = lambda df: {(r.factor, r.date): r for r in df.collect() if r.ic is not None or r.sums}
        want, got = rows_of(SC.daily_groups(Plan(roots).apply(panel, keep=("fwd",)), names)), rows_of(SC.section_groups(panel, roots, names))
        assert want.keys() == got.keys() and {f for f, _ in want} == set(roots)
        for k, r in want.items():
            assert r.counts == got[k].counts and (r.ic is None) == (got[k].ic is None) and abs((r.ic or 0) - (got[k].ic or 0)) < 1e-12
            assert all(abs(a - b) < 1e-12 for a, b in zip(r.sums or [], got[k].sums or [], strict=True))
    with pytest.raises(ValueError, match="histories"):
        SC.section_groups(panel, {"x": DELTA(RANK(close), 1)}, {"x": "x"})


def test_scorecard_shuffles_lines_by_symbol_and_known_values_by_date(spark):
    """Lines move by symbol and what is known of the scores by date; nothing else of the size of the panel is shuffled or sorted by rank."""
    panel = B.weekly_panel(spark, "/root/testdata/sf0.001", ("open", "close", "volume"))
    df = SC.section_groups(E.next_returns(E.padded_returns(panel)), RQ._ROOTS, RQ.SCORES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["date", "l_suppkey", "date"]  # the last one: the calendar's few dates
    assert "rank(" not in plan
    assert len(re.search(r"FlatMapGroupsInArrow \[date#\d+\], work\(([^)]*)\)", plan)[1].split(",")) == 8
    bars = B.weekly(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", re.sub(r"#\d+L?", "", bars)) == ["l_suppkey"]
