"""Studies that SQL can't express against plain versions; sinks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab import study_queries as Q
from factorlab.functions.alphas import definitions
from factorlab.functions.expr import CORR, COUNT, DELAY, DELTA, RANK, SMA, STD, SUM, TSRANK, field
from factorlab.operators import evaluation as E
from factorlab.operators import portfolio as P
from factorlab.operators import screening as SC
from factorlab.operators import statistics as S
from factorlab.plans import blocks as BL
from factorlab.sources import bars as B


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(4)
    rows = []
    for symbol, n in ((1, 300), (2, 260), (3, 40), (4, 1)):
        close = 20 * np.exp(rng.normal(0.0005, 0.02, n).cumsum())
        rows += [(symbol, int(k), float(c)) for k, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol long, k int, close double")
    return df.select("symbol", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")).alias("date"), "close").persist()


def test_grid_equals_the_backtest(prices):
    pairs = [(2, 5), (4, 20), (10, 60)]
    keys = ("symbol", "fast", "slow")
    got = {tuple(r[k] for k in keys): r for r in Q.grid_metrics(prices, pairs).collect()}
    want = P.metrics(P.signal_backtest(P.crossover(prices, pairs), keys), keys).collect()
    assert len(got) == len(want) == 12 and len(Q.GRID) == 544
    for r in want:
        mine = got[tuple(r[k] for k in keys)]
        for c in ("total_return", "ann_return", "sharpe", "max_drawdown", "n_trades"):
            assert (mine[c] is None) == (r[c] is None) and (r[c] is None or mine[c] == pytest.approx(r[c], abs=1e-9)), c


def plain_sharpe(close, fast, slow):
    held, net = 0.0, []
    for t in range(len(close)):
        before = held
        held = 1.0 if t - 1 >= slow - 1 and close[t - fast : t].mean() > close[t - slow : t].mean() + 1e-9 else 0.0
        if t:
            trade = held - before
            net.append(held * (close[t] / close[t - 1] - 1) - max(trade, 0) * P.BUY - max(-trade, 0) * P.SELL)
    s = np.std(net, ddof=1)
    return np.sqrt(252) * (np.mean(net) - 0.02 / 252) / s if s > 1e-12 else 0.0


def test_path_bootstrap(prices):
    got = {r.symbol: r for r in Q.path_sharpes(prices, 4, 20, reps=30).collect()}
    assert set(got) == {1, 2}
    for symbol in got:
        close = np.array([r.close for r in prices.where(f"symbol = {symbol}").orderBy("date").collect()])
        real = plain_sharpe(close, 4, 20)
        n, moves, better = len(close) - 1, close[1:] / close[:-1], 0
        for rep in range(30):
            draw = [int(S.lcg_numpy(np.array([i * 104729 + rep * 7919 + 42]))[0]) % n for i in range(n)]
            better += plain_sharpe(np.concatenate([[close[0]], close[0] * np.cumprod(moves[draw])]), 4, 20) >= real
        assert got[symbol].sharpe == pytest.approx(real, abs=1e-9) and got[symbol].p_value == pytest.approx(better / 30)


def test_block_sharpes(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(0.001, 0.01, 47), "b": rng.normal(0, 0.01, 15), "c": rng.normal(0, 0.01, 5)}
    rows = [(k, int(i), float(x)) for k, v in series.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "factor string, k int, ret double").select("factor", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")).alias("date"), "ret")
    got = {(r.factor, r.rep): r.sharpe for r in S.block_sharpes(df, "ret", "factor", reps=7, block=20).collect()}
    assert len(got) == 21
    for (name, rep), sharpe in got.items():
        x, n = series[name], len(series[name])
        draw = [(((rep * 7919 + k * 104729 + 42) * 48271 + 69621 + 11) % 2147483647 * 16807 + 7) % 2147483647 for k in range(n if n <= 20 else n // 20)]
        sample = np.array([x[d % n] for d in draw]) if n <= 20 else np.concatenate([x[d % (n - 20) :][:20] for d in draw])
        assert sharpe == pytest.approx(np.sqrt(252) * sample.mean() / sample.std() if n >= 10 else 0.0)


def test_p_values():
    # fixed values of Student's distribution
    for t, df, p in ((0.0, 5, 1.0), (2.0, 10, 0.07338803477), (-2.0, 10, 0.07338803477), (1.0, 1, 0.5), (12.706204736, 1, 0.05), (1.959963985, 1e7, 0.05)):
        assert S.tail(t, df) == pytest.approx(p, rel=1e-4)
    x = np.linspace(5.0, 105.0, 2_000_001)  # against the integral of the density
    density = (1 + x * x / 100) ** -50.5
    half = np.linspace(0.0, 105.0, 2_000_001)
    whole = 2 * np.trapezoid((1 + half * half / 100) ** -50.5, half)
    assert S.tail(5.0, 100) == pytest.approx(2 * np.trapezoid(density, x) / whole, rel=1e-5)


def test_auc_in_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k % 2), float(round(x, 1)), int(y)) for k, (x, y) in enumerate(zip(rng.normal(size=500), rng.integers(0, 2, 500), strict=True))]
    df = spark.createDataFrame(rows, "g int, score double, label int")

    def plain(own):
        up, down = [s for _, s, y in own if y == 1], [s for _, s, y in own if y == 0]
        return np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])

    assert S.auc(df, "score", "label").first().auc == pytest.approx(plain(rows))
    assert {r.g: r.auc for r in S.auc(df, "score", "label", ("g",), parts=5).collect()} == {k: pytest.approx(plain([r for r in rows if r[0] == k])) for k in (0, 1)}


def test_daily_metrics_equal_the_single_ones(spark):
    rng = np.random.default_rng(7)
    rows = [(s, d, float(rng.normal()), None if rng.random() < 0.1 else float(rng.integers(0, 9)), None if d == 3 else float(rng.normal())) for d in range(5) for s in range(40)]
    df = spark.createDataFrame(rows, "symbol long, k int, fwd double, x double, y double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")))
    got = {(r.factor, r.date): r for r in SC.daily_metrics(df, ["x", "y"]).collect()}
    for name in ("x", "y"):
        ic = {r.date: r.ic for r in E.rank_ic(df, name).collect()}
        slope = {r.date: r.slope for r in E.fama_macbeth_daily(df, name).collect()}
        full = {r.date: float(r.n == 5) for r in E.binned(df, name).groupBy("date").agg(F.countDistinct("bin").alias("n")).collect()}
        for column, want in (("ic", ic), ("slope", slope), ("full", full)):
            mine = {d: r[column] for (f, d), r in got.items() if f == name and r[column] is not None}
            assert mine == {d: pytest.approx(v) for d, v in want.items()}


def test_pool():
    metrics = {"alpha001": 0.01, "alpha055": 0.3, "a": 0.9, "b": -0.8, "c": 0.7, "d": 0.2}
    corr = {("a", "b"): 0.9, ("a", "c"): -0.5, ("b", "c"): 0.1, ("alpha055", "d"): -0.85}
    assert SC.pool(metrics, corr, size=2) == ["a", "c", "alpha001", "alpha055"]
    assert SC.pool(metrics, corr) == ["a", "c", "alpha055", "alpha001"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, None)], "k int, s string, v double")
    B.write_json(df, f"{tmp_path}/j")
    assert sorted(map(tuple, B.read_json(spark, f"{tmp_path}/j", "k int, s string, v double").collect())) == [(1, "x", 2.5), (2, None, None)]
    B.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, spark.read.option("header", True).schema("k int, s string, v double").csv(f"{tmp_path}/c").collect())) == [(1, "x", 2.5), (2, None, None)]


def test_patches_and_flags(spark):
    old = spark.createDataFrame([("d1", 1, 1.0), ("d1", 2, 2.0), ("d2", 1, 3.0), ("d3", 1, 4.0)], "date string, symbol int, value double")
    new = spark.createDataFrame([("d1", 1, 10.0), ("d2", 1, None)], "date string, symbol int, value double")
    assert sorted(map(tuple, B.patched(old, new).collect())) == [("d1", 1, 10.0), ("d1", 2, 2.0), ("d3", 1, 4.0)]
    assert [r.st for r in B.special_treatment(old).collect()] == [False] * 4


def test_scan_equals_single_backtests(spark):
    rng = np.random.default_rng(8)
    rows = [(i, k, float(rng.normal(0, 0.02)) if k else None, float(rng.normal()), float(rng.integers(0, 4))) for i in range(12) for k in range(130)]
    p = spark.createDataFrame(rows, "symbol long, k int, ret double, d2 double, d3 double").withColumn("date", F.date_add(F.lit("2020-01-10").cast("date"), F.col("k"))).drop("k").persist()
    schedule = P.rebalance_dates(p)
    scores = p.select("symbol", "date", F.explode(F.array(*(F.struct(F.lit(k).alias("delta"), F.col(f"d{k}").alias("score")) for k in (2, 3)))).alias("x")).select("symbol", "date", "x.*")
    got = {(r.delta, r.share, r.date): r for r in P.section_scan(p, scores, schedule, [0.1, 0.5]).collect()}
    assert len(got) == 4 * 130
    for delta in (2, 3):
        for share in (0.1, 0.5):
            one = p.withColumn("score", F.col(f"d{delta}"))
            for r in P.section_backtest(one, P.section_weights(one, schedule, share), schedule).collect():
                mine = got[delta, share, r.date]
                assert (mine.net, mine.bench, mine.equity) == pytest.approx((r.net, r.bench, r.equity), abs=1e-12)


def test_library_in_blocks_equals_the_windows(spark, monkeypatch):
    from factorlab.functions.alphas import PANEL, SPARSE, definitions
    from factorlab.plans.planner import Plan

    chosen = {f: d for f, d in definitions().items() if int(f[5:]) in (1, 2, 9, 14, 43, 58, 94, 106, 142, 143, 150, 191)}
    for calendar in (PANEL, SPARSE):
        assert any(d.calendar == calendar for d in chosen.values())
    monkeypatch.setattr(SC, "definitions", lambda: chosen)
    monkeypatch.setattr(SC, "BATCH", 7)
    bars = B.weekly(spark, "/root/testdata/sf0.01")
    bars = bars.where((F.col("symbol") < 24) & (F.col("date") < F.date_add(F.lit(bars.agg(F.min("date")).first()[0]), 500)))
    panel = E.next_returns(E.padded_returns(B.panel(bars))).localCheckpoint()
    daily = SC.library_metrics(panel)
    plan = daily._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    got = {(r.factor, r.date): (r.ic, r.slope, r.full) for r in daily.collect()}
    seen = 0
    for calendar, rows in ((PANEL, panel), (SPARSE, panel.where("close is not null"))):
        part = {f: d.expr for f, d in chosen.items() if d.calendar == calendar}
        for r in SC.daily_metrics(Plan(part).apply(rows, keep=["fwd"]), list(part)).collect():
            mine = got[r.factor, r.date]
            assert [x is None for x in mine] == [x is None for x in (r.ic, r.slope, r.full)]
            assert [x for x in mine if x is not None] == pytest.approx([x for x in (r.ic, r.slope, r.full) if x is not None], rel=1e-9, abs=1e-12)
            seen += r.ic is not None
    assert seen > 300


def test_the_library_is_shuffled_once_and_as_fields(spark, monkeypatch):
    """One table is written, and after the panel one shuffle moves fields and what looks far back, not a column a factor."""
    plans, write = [], SC.Written
    monkeypatch.setattr(SC, "Written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    rows = [(i, k, float(1 + (i * 7 + k * k) % 13)) for i in range(20) for k in range(40)]
    panel = spark.createDataFrame(rows, "symbol long, k int, close double").withColumn("date", F.date_add(F.lit("2020-01-03").cast("date"), F.col("k"))).drop("k")
    panel = panel.select("symbol", "date", *(F.col("close").alias(f) for f in B.FIELDS), F.lit(0.01).alias("fwd")).localCheckpoint()
    said = SC.library_metrics(panel)
    assert len(plans) == 1 and plans[0].count("Exchange") <= 2
    assert said.count() == 191 * 40
    assert len(BL.frontier(d.expr for d in definitions().values() if d.calendar == "panel")) <= 13


def test_a_panel_with_gaps_is_refused(spark):
    rows = spark.createDataFrame([(i, k) for i in range(12) for k in range(9) if (i, k) != (3, 4)], "symbol long, k int")
    panel = rows.select("symbol", F.date_add(F.lit("2020-01-03").cast("date"), F.col("k")).alias("date"), *(F.lit(1.0).alias(f) for f in (*B.FIELDS, "fwd")))
    with pytest.raises(Exception, match="a row for every symbol and date"):
        SC.library_metrics(panel)


def test_slices_equal_whole_histories():
    """Windows of ranks of windows, before the first row too, from slices and from the whole matrices."""
    a, b = field("a"), field("b")
    roots = [CORR(RANK(a / b), RANK(DELTA(b, 3)), 4), TSRANK(RANK(SUM(a, 5)), 3), RANK(SMA(a, 3, 1)) * DELAY(b, 2), COUNT(a > DELAY(a, 1), 4), STD(a / b, 3), a - b]
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, (30, 41)).astype(float), rng.integers(0, 4, (30, 41)).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    given, at = BL.frontier(roots), [a, b]
    steps, places = BL.program(given, at)
    held = [BL.run(steps, [x, y])[i] for i in places]
    plan = BL.sliced(roots, given)
    got = {}
    for start in range(0, 41, 8):
        for row, values in BL.rolled(plan, lambda k: [h[:, k] for h in held], 0, start, min(41, start + 8), 30):
            got[row] = [v.copy() for v in values]
    assert sorted(got) == list(range(41)) and max(plan[2]) < 16

    def plain(e):
        v = [plain(arg) for arg in e.args]
        if e.op == "rank":
            return np.stack([BL.shares(c) for c in v[0].T], 1)
        return {a: x, b: y}[e] if e.op == "field" else BL.value(e.op, e.params, v, tuple(arg.may_be_infinite for arg in e.args), x.shape)

    with np.errstate(all="ignore"):
        for i, e in enumerate(roots):
            np.testing.assert_array_equal(np.stack([got[k][i] for k in range(41)], 1), plain(e))


def test_pure_alpha_equals_its_sql_whatever_the_order_of_sums(spark, tmp_path):
    source = "/root/testdata/sf0.01/lineitem.parquet"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (l_suppkey + 1000 * k AS l_suppkey, l_orderkey + 1000000 * k AS l_orderkey) FROM '{source}', range(6) t(k)) TO '{tmp_path}/lineitem.parquet'")
    Q.QUERIES["pure_alpha"](spark, str(tmp_path)).write.parquet(str(tmp_path / "got"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
        c.execute(f"CREATE TABLE want AS {Q.SQL['pure_alpha']}")
        got = f"SELECT * FROM '{tmp_path}/got/*.parquet'"
        assert c.execute(f"SELECT count(*) FROM ({got})").fetchall() == c.execute("SELECT count(*) FROM want").fetchall()
        assert c.execute(f"SELECT count(*) FROM (FROM want EXCEPT ALL {got})").fetchall() == [(0,)]


def test_pure_alpha_of_a_single_return_is_the_sqls(spark, tmp_path):
    """A symbol whose only bar comes late has one return and no beta."""
    source = "/root/testdata/sf0.001/lineitem.parquet"
    last = f"(SELECT max(l_shipdate) FROM '{source}')"
    late = f"SELECT * REPLACE (90000 AS l_suppkey, {last} - INTERVAL 7 DAY AS l_shipdate) FROM (FROM '{source}' LIMIT 1)"
    duckdb.connect().execute(f"COPY (FROM '{source}' UNION ALL {late}) TO '{tmp_path}/lineitem.parquet'")
    Q.QUERIES["pure_alpha"](spark, str(tmp_path)).write.parquet(str(tmp_path / "got"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
        got, want = (c.execute(f"SELECT pure_alpha::VARCHAR FROM ({q}) WHERE symbol = 90000").fetchall() for q in (f"FROM '{tmp_path}/got/*.parquet'", Q.SQL["pure_alpha"]))
        assert [r[0].lstrip("-") for r in got] == [r[0].lstrip("-") for r in want] == ["nan"]
        assert c.execute(f"SELECT count(*) FROM (({Q.SQL['pure_alpha']}) EXCEPT ALL FROM '{tmp_path}/got/*.parquet')").fetchall() == [(0,)]
