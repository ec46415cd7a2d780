"""Queries of whole studies: the library's screening, the full parameter grid, walk-forwards, bootstraps, sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.alphas import PANEL, SPARSE, definitions
from .operators import evaluation as E
from .operators import models as MOD
from .operators import portfolio as P
from .operators import screening as SC
from .operators import statistics as S
from .operators import universe as U
from .plans.oracle import factor_ctes
from .plans.planner import Plan, nodes
from .research_queries import (
    _M, _Z, BACKTEST, CURVE, EPOCH_DAY, LABELS, MA, MONTHS, PERF, R, SCHEDULE, SCORES, SUMMARY, UNIVERSE, WEIGHTS,
    _ROOTS, D, H, all_metrics, base, bin_cte, excess, g, h, ic_cte, base_once, importance_sql, known_sql, members, metric_sql, moved_sql, out, placed_panel, ranks, snapshots, traded,
)
from .sources import bars as B
from .sources.scratch import Written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the whole library ---


def library(spark, sf_dir):
    return SC.library_metrics(E.next_returns(E.padded_returns(B.weekly_panel(spark, sf_dir))))


_NAMES = {c: [f.name for f in definitions().values() if f.calendar == c] for c in (PANEL, SPARSE)}
_LIBRARY = f"""WITH {B.SQL}, {factor_ctes({n: definitions()[n].expr for n in _NAMES[PANEL]}, 'panel', 'fp')},
{factor_ctes({n: definitions()[n].expr for n in _NAMES[SPARSE]}, 'bars', 'fs')},
pads AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS pad FROM panel),
rets AS (SELECT symbol, date, pad / lag(pad) OVER {H} - 1 AS ret FROM pads),
fwds AS MATERIALIZED (SELECT symbol, date, coalesce(lead(coalesce(ret, 0)) OVER {H}, 0) AS fwd FROM rets),
long AS MATERIALIZED (SELECT factor, date, symbol, score, fwd FROM (
  SELECT * FROM (UNPIVOT fp ON {', '.join(_NAMES[PANEL])} INTO NAME factor VALUE score) UNION ALL BY NAME SELECT * FROM (UNPIVOT fs ON {', '.join(_NAMES[SPARSE])} INTO NAME factor VALUE score)) JOIN fwds USING (symbol, date) WHERE isfinite(score)),
ic AS MATERIALIZED (SELECT factor, date, corr(a, b) AS ic FROM (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY score) + (count(*) OVER (PARTITION BY factor, date, score) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY factor, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, date, fwd) - 1) / 2.0 AS b FROM long)
  GROUP BY factor, date HAVING count(*) >= 10 AND min(a) < max(a) AND min(b) < max(b)),
fm AS (SELECT factor, date, covar_samp(score, fwd) / var_pop(score) AS slope FROM long GROUP BY factor, date HAVING count(*) >= 10 AND var_pop(score) >= 1e-12),
cut AS (SELECT factor, date, list_distinct(quantile_cont(score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM long GROUP BY factor, date HAVING count(*) >= 15),
cs AS (SELECT factor, date, (count(DISTINCT greatest(len(list_filter(e, lambda x: x < score - 1e-9)) - 1, 0)) = 5)::INT AS f FROM long JOIN cut USING (factor, date) GROUP BY factor, date),
m AS MATERIALIZED (SELECT factor, ic_ir, fm_t, cs_effective_ratio, coalesce(abs(ic_ir) > 0.05 AND abs(fm_t) > 2 AND cs_effective_ratio > 0.5, false) AS passed FROM (SELECT DISTINCT factor FROM (FROM ic SELECT factor UNION ALL FROM fm SELECT factor UNION ALL FROM cs SELECT factor))
  LEFT JOIN (SELECT factor, avg(ic) / nullif(stddev_pop(ic), 0) AS ic_ir FROM ic GROUP BY 1) USING (factor) LEFT JOIN (SELECT factor, avg(slope) / nullif(stddev_pop(slope), 0) * sqrt(count(*)) AS fm_t FROM fm GROUP BY 1) USING (factor)
  LEFT JOIN (SELECT factor, avg(f) AS cs_effective_ratio FROM cs GROUP BY 1) USING (factor))"""


@query(f"{_LIBRARY} SELECT factor, {g('ic_ir')}, {g('fm_t')}, {g('cs_effective_ratio')}, passed FROM m WHERE coalesce(ic_ir, fm_t, cs_effective_ratio) IS NOT NULL")
def purify_all(spark, sf_dir):
    """All factors of the library against the three gates; factors without any metric are left out."""
    m = SC.purified(library(spark, sf_dir)).where("ic_ir IS NOT NULL OR fm_t IS NOT NULL OR cs_effective_ratio IS NOT NULL")
    return out(m, "factor", "ic_ir", "fm_t", "cs_effective_ratio", "passed")


@query(f"""{_LIBRARY}, chosen AS (SELECT factor FROM m WHERE passed OR factor IN {SC.MUST_KEEP}), ics AS (SELECT * FROM ic JOIN chosen USING (factor)),
whole AS (SELECT * FROM ics WHERE date IN (SELECT date FROM ics GROUP BY date HAVING count(*) = (SELECT count(DISTINCT factor) FROM ics))), c AS (SELECT a.factor AS factor_a, b.factor AS factor_b, corr(a.ic, b.ic) AS corr FROM whole a JOIN whole b USING (date) GROUP BY ALL) SELECT factor_a, factor_b, {g('corr')} FROM c""")
def ic_corr_all(spark, sf_dir):
    """Correlation of the ICs of all factors that pass or must be kept."""
    daily = library(spark, sf_dir)
    return out(E.ic_correlation(SC.candidates(daily, SC.purified(daily))), "factor_a", "factor_b", "corr")


@query()
def factor_pool(spark, sf_dir):
    """The final pool from the whole library: gates, greedy removal at 0.8, the 15 best and those to keep."""
    daily = library(spark, sf_dir)
    metrics = SC.purified(daily)
    ics = Written(SC.candidates(daily, metrics)).df
    corr = {(r["factor_a"], r["factor_b"]): r["corr"] for r in E.ic_correlation(ics).collect()}  # factors squared
    ir = {r["factor"]: r["ic_ir"] or 0.0 for r in metrics.join(ics.select("factor").distinct(), "factor").select("factor", "ic_ir").collect()}
    return spark.createDataFrame(list(enumerate(SC.pool(ir, corr))), "place int, factor string")


# --- the full grid of moving averages ---

#: Lengths of the fast and the slow average.
FAST, SLOW = range(2, 61, 2), range(10, 121, 5)
GRID = [(f, s) for f in FAST for s in SLOW if f < s]


def grid_metrics(bars: DataFrame, pairs: list[tuple[int, int]] = GRID) -> DataFrame:
    """The metrics of the crossover backtest for every symbol and pair: each length is averaged once and all pairs
    run side by side, as columns of a matrix. A symbol's bars are one group; no row is copied per pair."""
    kind = bars.schema["symbol"].dataType.simpleString()
    names = [*_M, "n_trades"]

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        close, day = rows.column("close").to_numpy(), rows.column("date").to_numpy().astype("datetime64[D]").astype(int)
        t, sums = len(close), np.concatenate([[0.0], np.cumsum(close)])
        mean = {n: np.concatenate([np.full(min(n - 1, t), np.nan), (sums[n:] - sums[:-n]) / n]) for n in {n for p in pairs for n in p}}
        signal = np.stack([mean[f] > mean[s] + 1e-9 for f, s in pairs], 1).astype(float)
        held = np.concatenate([np.zeros((1, len(pairs))), signal[:-1]])
        ret = np.concatenate([[0.0], close[1:] / close[:-1] - 1])
        trade = np.diff(held, axis=0)
        net = held[1:] * ret[1:, None] - np.maximum(trade, 0) * P.BUY - np.maximum(-trade, 0) * P.SELL
        equity = np.cumprod(1 + net, 0)
        years = (day[-1] - day[0]) / 365.25
        s = net.std(0, ddof=1) if t > 2 else np.full(len(pairs), np.nan)
        sharpe = np.where(s > 1e-12, np.sqrt(252.0) * (net.mean(0) - 0.02 / 252) / np.where(s > 1e-12, s, 1.0), 0.0) if t > 1 else np.zeros(len(pairs))
        last = equity[-1] if t > 1 else np.full(len(pairs), np.nan)
        down = (equity / np.maximum.accumulate(equity, 0) - 1).min(0) if t > 1 else last
        columns = [last - 1, last ** (1 / years) - 1 if years > 0 else np.zeros(len(pairs)), sharpe, down]
        trades = np.abs(trade).sum(0).astype(int) if t > 1 else [None] * len(pairs)
        return pa.table([pa.array(rows.column("symbol").to_pylist()[:1] * len(pairs), rows.schema.field("symbol").type), pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()), *(pa.array(c, from_pandas=True) for c in columns), pa.array(trades, pa.int64())], names=["symbol", "fast", "slow", *names])

    return bars.select("symbol", "date", "close").groupBy("symbol").applyInArrow(work, f"symbol {kind}, fast int, slow int, {', '.join(f'{n} double' for n in _M)}, n_trades long")


_LENGTHS = sorted({n for p in GRID for n in p})
_MEANS = f"mm AS MATERIALIZED (SELECT symbol, date, close, [{', '.join(f'CASE WHEN count(close) OVER {h(n - 1)} = {n} THEN avg(close) OVER {h(n - 1)} END' for n in _LENGTHS)}] AS m FROM bars)"
_GRID_MA = f"{_MEANS}, sig AS (SELECT symbol, date, close, f AS fast, s AS slow, coalesce(m[list_position({_LENGTHS}, f)] > m[list_position({_LENGTHS}, s)] + 1e-9, false)::INT AS signal FROM mm, (VALUES {', '.join(map(str, GRID))}) v(f, s)),{MA[MA.index('b0 AS') - 1:]}"
_GRID_M = f"m AS MATERIALIZED ({metric_sql('sb', 'symbol, fast, slow', 'sum(abs(trade))::BIGINT')})"


@query(f"WITH {B.SQL}, {_GRID_MA}, {_GRID_M} SELECT symbol, fast, slow, {', '.join(map(g, _M))}, n_trades FROM m")
def ma_grid_all(spark, sf_dir):
    return out(grid_metrics(B.weekly(spark, sf_dir)), "symbol", "fast", "slow", *_M, "n_trades")


@query(f"""WITH {B.SQL}, {_GRID_MA}, {_GRID_M}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round_even(sharpe * 1048576, 0) DESC, fast, slow) AS i FROM m), b AS (SELECT symbol, fast, slow, sharpe FROM k WHERE i = 1),
o AS (SELECT b.symbol, b.fast, b.slow, b.sharpe, avg((m.sharpe > 0)::INT) AS positive_ratio, avg(m.sharpe) FILTER (abs(m.fast - b.fast) <= 4 AND abs(m.slow - b.slow) <= 15) AS plateau FROM b JOIN m USING (symbol) GROUP BY ALL)
SELECT symbol, fast, slow, {g('sharpe')}, {g('positive_ratio')}, {g('plateau')}, {g('CASE WHEN sharpe > 0 THEN plateau / sharpe ELSE 0 END', 'plateau_ratio')} FROM o""")
def ma_plateau(spark, sf_dir):
    """The best pair of each symbol, how many pairs are above zero, and how its neighbours do compared with it."""
    m = Written(grid_metrics(B.weekly(spark, sf_dir)).select("symbol", "fast", "slow", "sharpe")).df  # read twice
    key = F.struct(F.rint(F.col("sharpe") * 1048576).alias("s"), (-F.col("fast")).alias("f"), (-F.col("slow")).alias("l"))
    best = m.groupBy("symbol").agg(F.max_by(F.struct("fast", "slow", "sharpe"), key).alias("b"))
    near = (F.abs(F.col("fast") - F.col("b.fast")) <= 4) & (F.abs(F.col("slow") - F.col("b.slow")) <= 15)
    o = m.join(best, "symbol").groupBy("symbol", "b").agg(F.avg((F.col("sharpe") > 0).cast("double")).alias("positive_ratio"), F.avg(F.when(near, F.col("sharpe"))).alias("plateau"))
    o = o.select("symbol", "b.fast", "b.slow", "b.sharpe", "positive_ratio", "plateau")
    return out(o.withColumn("plateau_ratio", F.when(F.col("sharpe") > 0, F.col("plateau") / F.col("sharpe")).otherwise(0.0)), "symbol", "fast", "slow", "sharpe", "positive_ratio", "plateau", "plateau_ratio")


# --- cross-section backtest over a universe, with delistings ---


def _over(sql: str) -> str:
    """The same CTEs over the table rx."""
    return re.sub(r"\br\b", "rx", sql)


@query(f"""{R}, {UNIVERSE}, gone AS (SELECT symbol, max(date) AS delist_date FROM bars WHERE symbol % 10 = 0 AND date <= '1999-12-31' GROUP BY 1),
rx AS MATERIALIZED (SELECT symbol, date, CASE WHEN member THEN score END AS score, CASE WHEN date > delist_date THEN NULL WHEN date = delist_date AND b IS NOT NULL THEN close * 0.9 / b - 1 ELSE ret END AS ret FROM (SELECT u.*, lag(close) OVER {H} AS b FROM u) LEFT JOIN gone USING (symbol)),
{_over(SCHEDULE.format(unit='month'))}, {_over(WEIGHTS)}, {_over(BACKTEST)} SELECT {D}, {', '.join(map(g, ('gross', 'cost', 'net', 'bench', 'equity', 'benchmark', 'turnover')))} FROM bt""")
def xs_backtest_universe(spark, sf_dir):
    """Only members of the day's universe are ranked, and delisted names end at their liquidation price."""
    bars = B.weekly(spark, sf_dir)
    gone = bars.where((F.col("symbol") % 10 == 0) & (F.col("date") <= F.lit("1999-12-31").cast("date"))).groupBy("symbol").agg(F.max("date").alias("delist_date")).withColumn("liquidation_price", F.lit(None).cast("double"))
    p = P.delisted(members(spark, sf_dir), gone).withColumn("score", F.when(F.col("member"), F.col("score")))
    schedule = P.rebalance_dates(p)
    return out(P.section_backtest(p, P.section_weights(p, schedule, 0.2, 0.2), schedule), "date", "gross", "cost", "net", "bench", "equity", "benchmark", "turnover")


# --- feature matrix, evaluation of predictions, walk-forwards ---

_MARKET = f"""v AS (SELECT date, member, CASE WHEN count(ret) OVER {h(19)} = 20 THEN stddev_samp(ret) OVER {h(19)} END AS vol, CASE WHEN count(volume) OVER {h(19)} = 20 THEN avg(volume) OVER {h(19)} END / CASE WHEN count(volume) OVER {h(51)} = 52 THEN avg(volume) OVER {h(51)} END AS t FROM u),
mk AS (SELECT date, avg(vol) FILTER (member) AS market_vol_20d, avg(t) FILTER (member) AS market_turnover_20d FROM v GROUP BY date)"""
_FEATURES = (*SCORES, "market_vol_20d", "market_turnover_20d", "fwd")


@query(f"{R}, {UNIVERSE}, {_MARKET} SELECT symbol, {D}, {', '.join(map(g, _FEATURES))} FROM u JOIN mk USING (date) JOIN (SELECT symbol, date, fwd FROM n) USING (symbol, date) WHERE member AND coalesce({', '.join(SCORES)}) IS NOT NULL")
def feature_matrix(spark, sf_dir):
    """A row per member and date: factors, market features and the next return."""
    m = E.next_returns(members(spark, sf_dir))
    market = S.market_features(m, 20, 52)  # a row a date
    x = m.where(F.col("member") & F.coalesce(*SCORES).isNotNull()).join(F.broadcast(market), "date")
    return out(x, "symbol", "date", *_FEATURES)


_N1 = f"n1 AS MATERIALIZED (SELECT *, lead(close, 2) OVER {H} / lead(close, 1) OVER {H} - 1 AS fwd FROM r)"


@query(f"""{R}, {_N1}, {ic_cte(source='n1')}, {bin_cte(source='n1')}, {CURVE}, i AS (SELECT {SUMMARY} FROM ic), ps AS (SELECT date, ls_ret AS port_ret, product(1 + ls_ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM ls WHERE ls_ret IS NOT NULL),
p AS (SELECT {PERF}, min(dd) AS mdd FROM (SELECT *, cum / max(cum) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ps)) SELECT {', '.join(map(g, ('ic_mean', 'ic_ir', 'ic_t', 'annual', 'sharpe', 'mdd')))}, n FROM i, p""")
def evaluate_oof(spark, sf_dir):
    """Predictions against the return from the next close to the one after: IC summary and the long-short curve's."""
    x = E.horizon_returns(base(spark, sf_dir), 1)
    ls = E.long_short_curve(E.quantile_returns(x)).select("date", F.col("ls_ret").alias("port_ret"))
    return out(E.ic_summary(E.rank_ic(x)).crossJoin(F.broadcast(P.performance(ls))), "ic_mean", "ic_ir", "ic_t", "annual", "sharpe", "mdd", "n")


_PAIR = "k AS MATERIALIZED (SELECT year(date)::INT AS y, symbol, date, score AS a, score2 AS b, fwd FROM n WHERE score IS NOT NULL AND score2 IS NOT NULL)"


@query(f"""{R}, {_PAIR}, tr AS (SELECT t.y AS test_year, count(*) AS n_train, var_pop(a) AS v1, var_pop(b) AS v2, covar_pop(a, b) AS c12, covar_pop(a, fwd) AS c1, covar_pop(b, fwd) AS c2 FROM (SELECT DISTINCT y FROM k) t JOIN k ON k.y < t.y GROUP BY 1 HAVING count(*) >= 1000),
fit AS (SELECT test_year, n_train, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b_score, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b_score2 FROM tr WHERE v1 * v2 - c12 * c12 > 1e-12),
pr AS (SELECT test_year, date, n_train, b_score, b_score2, round_even((b_score * a + b_score2 * b) * 1073741824, 0) AS pred, fwd FROM fit JOIN k ON k.y = test_year),
icp AS (SELECT test_year, date, corr(x, z) AS ic FROM (SELECT test_year, date, {ranks('pred')} AS x, {ranks('fwd')} AS z FROM pr) GROUP BY ALL HAVING count(*) >= 10 AND min(x) < max(x) AND min(z) < max(z)),
s AS (SELECT test_year, any_value(n_train) AS n_train, count(*) AS n_test, any_value(b_score) AS b_score, any_value(b_score2) AS b_score2 FROM pr GROUP BY 1 HAVING count(*) >= 100)
SELECT test_year, n_train, n_test, {g('b_score')}, {g('b_score2')}, {g('ic_mean')} FROM s JOIN (SELECT test_year, avg(ic) AS ic_mean FROM icp GROUP BY 1) USING (test_year)""")
def walk_forward_fit(spark, sf_dir):
    """For each year a regression on all earlier years, tested on the year: yearly sums are added up, a row a year."""
    k = E.next_returns(base(spark, sf_dir)).where("score IS NOT NULL AND score2 IS NOT NULL").select(F.year("date").alias("y"), "date", F.col("score").alias("a"), F.col("score2").alias("b"), "fwd")
    pairs = [("a", "a"), ("b", "b"), ("a", "b"), ("a", "fwd"), ("b", "fwd")]
    sums = k.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("a", "b", "fwd")), *(F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for p, q in pairs))
    before = Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("y", F.col("n").alias("n_test"), *(F.sum(c).over(before).alias(c) for c in sums.columns[1:]))
    cov = lambda p, q: F.col(f"{p}_{q}") / F.col("n") - F.col(p) * F.col(q) / (F.col("n") * F.col("n"))
    v1, v2, c12, c1, c2 = (cov(p, q) for p, q in pairs)
    det = v1 * v2 - c12 * c12
    fit = sums.where((F.col("n") >= 1000) & (F.col("n_test") >= 100) & (det > 1e-12))
    fit = fit.select(F.col("y"), F.col("n").alias("n_train"), "n_test", ((c1 * v2 - c2 * c12) / det).alias("b_score"), ((c2 * v1 - c1 * c12) / det).alias("b_score2"))
    pred = k.join(F.broadcast(fit), "y").select("date", "fwd", F.rint((F.col("b_score") * F.col("a") + F.col("b_score2") * F.col("b")) * float(1 << 30)).alias("score"))
    ic = E.rank_ic(pred).groupBy(F.year("date").alias("y")).agg(F.avg("ic").alias("ic_mean"))
    return out(fit.join(ic, "y").withColumnRenamed("y", "test_year"), "test_year", "n_train", "n_test", "b_score", "b_score2", "ic_mean")


_ALL_ICS = ", ".join(ic_cte(k, f"ic_{k}") for k in SCORES) + ", ics AS (" + " UNION ALL ".join(f"SELECT '{k}' AS s, date, ic FROM ic_{k}" for k in SCORES) + ")"
_Z4 = ", ".join(f"coalesce(({k} - avg({k}) OVER (PARTITION BY date)) / (stddev_samp({k}) OVER (PARTITION BY date) + 1e-12), 0) AS {k}" for k in SCORES)


@query(f"""{R}, {_ALL_ICS}, ir AS (SELECT t.y AS test_year, s, avg(ic) / nullif(stddev_pop(ic), 0) AS ir FROM (SELECT DISTINCT year(date)::INT AS y FROM ics) t JOIN ics ON year(date) < t.y GROUP BY ALL),
w AS (SELECT test_year, s, ir / sum(abs(ir)) OVER (PARTITION BY test_year) AS w FROM ir WHERE abs(ir) > 0.05), z AS (SELECT symbol, date, fwd, {_Z4} FROM n),
c AS (SELECT test_year, date, round_even(({' + '.join(f"{k} * coalesce(w_{k}, 0)" for k in SCORES)}) * 1073741824, 0) AS pred, fwd FROM z JOIN (SELECT test_year, {', '.join(f"max(w) FILTER (s = '{k}') AS w_{k}" for k in SCORES)} FROM w GROUP BY 1) ON test_year = year(date)),
icp AS (SELECT test_year, date, corr(x, y) AS ic FROM (SELECT test_year, date, {ranks('pred')} AS x, {ranks('fwd')} AS y FROM c) GROUP BY ALL HAVING count(*) >= 10 AND min(x) < max(x) AND min(y) < max(y)), o AS (SELECT test_year, avg(ic) AS ic_mean FROM icp GROUP BY 1)
SELECT test_year, n_factors, {g('ic_mean')} FROM o JOIN (SELECT test_year, count(*) AS n_factors FROM w GROUP BY 1) USING (test_year)""")
def walk_forward_reselect(spark, sf_dir):
    """Factors chosen and weighted anew each year by the ICs of all earlier years, then tested on the year."""
    p = base_once(spark, sf_dir)
    ics = Written(all_metrics(p)[1].select(F.year("date").alias("y"), "factor", "ic")).df  # read twice
    years = ics.select(F.col("y").alias("test_year")).distinct()
    past = ics.join(F.broadcast(years), F.col("y") < F.col("test_year"))  # a row per factor and date
    ir = past.groupBy("test_year", "factor").agg(F.try_divide(F.avg("ic"), F.stddev_pop("ic")).alias("ir")).where(F.abs("ir") > 0.05)
    w = ir.withColumn("w", F.col("ir") / F.sum(F.abs("ir")).over(Window.partitionBy("test_year")))
    w = w.groupBy("test_year").agg(F.count(F.lit(1)).alias("n_factors"), *(F.coalesce(F.max(F.when(F.col("factor") == v, F.col("w"))), F.lit(0.0)).alias(f"w_{k}") for k, v in SCORES.items()))
    z = E.zscores(E.next_returns(p), list(SCORES)).withColumn("test_year", F.year("date")).join(F.broadcast(w), "test_year")
    pred = sum((F.coalesce(k, F.lit(0.0)) * F.col(f"w_{k}") for k in SCORES), F.lit(0.0))
    ic = E.rank_ic(z.select("date", "fwd", F.rint(pred * float(1 << 30)).alias("score"))).groupBy(F.year("date").alias("test_year")).agg(F.avg("ic").alias("ic_mean"))
    return out(ic.join(w.select("test_year", "n_factors"), "test_year"), "test_year", "n_factors", "ic_mean")


# --- bootstraps, attribution, risk ---


def long_shorts(p: DataFrame) -> DataFrame:
    """(factor, date, ret): the long-short return of each score."""
    x, runs = E.next_returns(p), None
    for k, v in SCORES.items():
        one = E.long_short_curve(E.quantile_returns(x, k)).select(F.lit(v).alias("factor"), "date", F.col("ls_ret").alias("ret"))
        runs = one if runs is None else runs.union(one)
    return runs


@query()
def factor_bootstrap(spark, sf_dir):
    """(factor, p_value, positive): whole-block samples of each factor's long-short returns."""
    b = S.block_sharpes(long_shorts(base_once(spark, sf_dir)), "ret", "factor")
    return out(b.groupBy("factor").agg(F.avg((F.col("sharpe") <= 0).cast("double")).alias("p_value"), F.avg((F.col("sharpe") > 0).cast("double")).alias("positive")), "factor", "p_value", "positive")


def path_sharpes(bars: DataFrame, fast: int = 4, slow: int = 100, reps: int = 200, least: int = 200) -> DataFrame:
    """(symbol, sharpe, p_value): the strategy's Sharpe ratio, and the share of paths that do as well; a path is rebuilt
    from the symbol's returns drawn with replacement. All paths of a symbol run side by side."""
    kind = bars.schema["symbol"].dataType.simpleString()

    def sharpe(close: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, close.shape[1])), np.cumsum(close, 0)])
        mean = {n: (sums[n:] - sums[:-n]) / n for n in (fast, slow)}
        signal = np.concatenate([np.zeros((slow - 1, close.shape[1])), mean[fast][slow - fast :] > mean[slow] + 1e-9])
        held = np.concatenate([np.zeros((1, close.shape[1])), signal[:-1]])
        trade = np.diff(held, axis=0)
        net = held[1:] * (close[1:] / close[:-1] - 1) - np.maximum(trade, 0) * P.BUY - np.maximum(-trade, 0) * P.SELL
        s = net.std(0, ddof=1)
        return np.where(s > 1e-12, np.sqrt(252.0) * (net.mean(0) - 0.02 / 252) / np.where(s > 1e-12, s, 1.0), 0.0)

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        close = rows.column("close").to_numpy()
        n, own = len(close) - 1, rows.column("symbol").slice(0, 1)
        if n < max(least, slow + 1):
            return pa.table({"symbol": own.slice(1), "sharpe": pa.array([], pa.float64()), "p_value": pa.array([], pa.float64())})
        draw = S.lcg_numpy(np.arange(n)[:, None] * 104729 + np.arange(reps) * 7919 + 42) % n
        paths = np.concatenate([np.full((1, reps), close[0]), close[0] * np.cumprod((close[1:] / close[:-1])[draw], 0)])
        real = sharpe(close[:, None])[0]
        return pa.table({"symbol": own, "sharpe": pa.array([real]), "p_value": pa.array([float((sharpe(paths) >= real).mean())])})

    return bars.select("symbol", "date", "close").groupBy("symbol").applyInArrow(work, f"symbol {kind}, sharpe double, p_value double")


@query()
def path_bootstrap(spark, sf_dir):
    return out(path_sharpes(B.weekly(spark, sf_dir)), "symbol", "sharpe", "p_value")


@query()
def capm_p_values(spark, sf_dir):
    c = S.capm(excess(spark, sf_dir), ("symbol",)).withColumn("alpha_p", S.p_values(F.col("t_alpha"), (F.col("n") - 2).cast("double")))
    return out(c, "symbol", "alpha", "t_alpha", "alpha_p", "n")


@query(f"""{R}, cx AS MATERIALIZED (SELECT symbol, date, ret - 0.03 / 252 AS y, avg(round_even(ret * 1073741824, 0) / 1073741824) OVER (PARTITION BY date) - 0.03 / 252 AS x FROM r WHERE ret IS NOT NULL),
s AS (SELECT symbol, round_even(covar_pop(y, x) / var_pop(x) * 1048576, 0) / 1048576 AS beta FROM cx GROUP BY symbol), k AS (SELECT symbol, date, 1 + coalesce(y - beta * x, 0) AS f FROM cx JOIN s USING (symbol)),
o AS (SELECT symbol, unnest(list(date ORDER BY date)) AS date, unnest(list_reduce(list([f] ORDER BY date), lambda a, b: list_append(a, a[-1] * b[1]))) AS pure_alpha FROM k GROUP BY symbol) SELECT symbol, {D}, {g('pure_alpha')} FROM o""")
def pure_alpha(spark, sf_dir):
    """The compounded part of each symbol's excess return that its beta doesn't explain. Products reach 1e286, so that a last bit
    of the market's mean tells: it is the mean of returns in steps of 2^-30, whose sum is exact in any order, and factors
    are multiplied date by date. Without a beta (a single return) the result is NaN, as in SQL, where 0 / 0 is NaN and no null."""
    p = base(spark, sf_dir).where(F.col("ret").isNotNull())
    p = p.select("symbol", "date", (F.col("ret") - 0.03 / 252).alias("y"), (F.avg(F.rint(F.col("ret") * float(1 << 30)) / float(1 << 30)).over(E.day()) - 0.03 / 252).alias("x"))
    x = p.join(S.capm(p, ("symbol",)).select("symbol", F.coalesce(F.rint(F.col("beta") * 1048576) / 1048576, F.lit(float("nan"))).alias("beta")), "symbol")
    own = F.coalesce(F.col("y") - F.col("beta") * F.col("x"), F.lit(0.0))
    return out(x.withColumn("pure_alpha", F.product(1 + own).over(E.history().rowsBetween(Window.unboundedPreceding, 0))), "symbol", "date", "pure_alpha")


_TRADED = f"WITH {B.SQL}, {MA}, tb AS MATERIALIZED (SELECT * FROM sb WHERE fast = 4 AND slow = 20)"


@query(f"{_TRADED}, m AS ({metric_sql('tb', 'symbol')}) SELECT symbol, {g('CASE WHEN max_drawdown < 0 THEN ann_return / abs(max_drawdown) ELSE 0 END', 'calmar')} FROM m")
def calmar(spark, sf_dir):
    m = P.metrics(traded(spark, sf_dir, [(4, 20)]), ("symbol",))
    return out(m.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("ann_return") / F.abs("max_drawdown")).otherwise(0.0)), "symbol", "calmar")


@query(f"{_TRADED}, k AS (SELECT symbol, date, CASE WHEN count(net) OVER {h(51)} = 52 THEN CASE WHEN stddev_samp(net) OVER {h(51)} > 1e-12 THEN sqrt(252.0) * (avg(net) OVER {h(51)} - 0.02 / 252) / stddev_samp(net) OVER {h(51)} ELSE 0 END END AS rolling_sharpe FROM tb WHERE net IS NOT NULL) SELECT symbol, {D}, {g('rolling_sharpe')} FROM k")
def rolling_sharpe(spark, sf_dir):
    w = E.history().rowsBetween(-51, 0)
    s = F.stddev_samp("net").over(w)
    value = F.when(s > 1e-12, F.sqrt(F.lit(252.0)) * (F.avg("net").over(w) - 0.02 / 252) / s).otherwise(0.0)
    t = traded(spark, sf_dir, [(4, 20)]).where(F.col("net").isNotNull())
    return out(t.withColumn("rolling_sharpe", F.when(F.count("net").over(w) == 52, value)), "symbol", "date", "rolling_sharpe")


@query()
def scorecard(spark, sf_dir):
    """Each score's checks: IC, long-short Sharpe ratio, bootstrap, rising quantile groups; and how many it meets."""
    read = tuple(sorted({"close", *(x.params[0] for x in nodes(_ROOTS.values()) if x.op == "field")}))
    p = E.next_returns(E.padded_returns(B.weekly_panel(spark, sf_dir, read)))
    daily = Written(SC.section_groups(p, _ROOTS, SCORES)).df  # a row a factor and date
    metrics = E.ic_summary(daily.where(F.col("ic").isNotNull()), ("factor",)).select("factor", "ic_ir", "ic_t")
    group = lambda i: F.try_divide(F.col("sums")[i], F.col("counts")[i])
    runs = daily.where(F.col("sums").isNotNull()).select("factor", "date", (group(4) - group(0) - E.PAIR_COST).alias("ret"))
    ls = P.performance(runs.withColumnRenamed("ret", "port_ret"), keys=("factor",)).select("factor", F.col("sharpe").alias("ls_sharpe"))
    boot = S.block_sharpes(runs, "ret", "factor").groupBy("factor").agg(F.avg((F.col("sharpe") <= 0).cast("double")).alias("p_value"))
    means = daily.groupBy("factor").agg(*(F.try_divide(F.sum(F.col("sums")[i]), F.sum(F.col("counts")[i])).alias(f"m{i}") for i in range(5)))
    rising = means.select("factor", ((F.col("m0") < F.col("m1")) & (F.col("m1") < F.col("m2")) & (F.col("m2") < F.col("m3")) & (F.col("m3") < F.col("m4"))).alias("monotone"))
    s = metrics.join(ls, "factor").join(boot, "factor").join(rising, "factor")
    checks = [(F.abs("ic_ir") > 0.05) & (F.abs("ic_t") > 2), F.abs("ls_sharpe") > 0.3, F.col("p_value") < 0.1, F.col("monotone")]
    s = s.withColumn("passed", sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0)))
    return out(s.withColumn("verdict", F.when(F.col("passed") >= 3, "usable").when(F.col("passed") >= 2, "weak").otherwise("void")), "factor", "ic_ir", "ic_t", "ls_sharpe", "p_value", "monotone", "passed", "verdict")


# --- sources and relational forms ---

_EVENTS = "rec AS (SELECT l_shipdate AS date, l_suppkey AS symbol, l_extendedprice AS value, l_orderkey * 8 + l_linenumber AS seq FROM lineitem), cells AS (SELECT date, symbol, max_by(value, seq) AS value FROM rec GROUP BY ALL)"


def records(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("symbol"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


@query(f"WITH {_EVENTS} SELECT date::DATE::VARCHAR AS date, symbol, {g('value')} FROM cells")
def records_keep_last(spark, sf_dir):
    return out(B.keep_last(records(spark, sf_dir)), "date", "symbol", "value")


@query(f"WITH {_EVENTS} SELECT date::DATE::VARCHAR AS date, {', '.join(g(f'max(value) FILTER (symbol = {k})', f's{k}') for k in range(1, 6))} FROM cells WHERE symbol BETWEEN 1 AND 5 GROUP BY date")
def records_to_wide(spark, sf_dir):
    wide = B.pivoted(B.keep_last(records(spark, sf_dir)).where(F.col("symbol").between(1, 5)), list(range(1, 6)))
    return out(wide.select("date", *(F.col(str(k)).alias(f"s{k}") for k in range(1, 6))), "date", *(f"s{k}" for k in range(1, 6)))


@query(f"WITH {_EVENTS} SELECT date::DATE::VARCHAR AS date, symbol::VARCHAR AS symbol, {g('value')} FROM cells WHERE symbol BETWEEN 1 AND 5")
def wide_to_records(spark, sf_dir):
    wide = B.pivoted(B.keep_last(records(spark, sf_dir)).where(F.col("symbol").between(1, 5)), list(range(1, 6)))
    return out(B.unpivoted(wide), "date", "symbol", "value")


@query(f"""WITH {_EVENTS}, fresh AS (SELECT date, symbol, value * 2 AS value FROM cells WHERE date >= '1998-01-01' AND symbol % 2 = 0),
o AS (SELECT date, symbol, value FROM cells WHERE NOT (date IN (SELECT date FROM fresh) AND symbol IN (SELECT symbol FROM fresh)) UNION ALL SELECT * FROM fresh) SELECT date::DATE::VARCHAR AS date, symbol, {g('value')} FROM o""")
def checkpoint_merge(spark, sf_dir):
    old = B.keep_last(records(spark, sf_dir))
    new = old.where((F.col("date") >= F.lit("1998-01-01").cast("date")) & (F.col("symbol") % 2 == 0)).withColumn("value", F.col("value") * 2)
    return out(B.patched(old, new), "date", "symbol", "value")


@query(f"WITH {B.SQL}, e AS (SELECT max(date) AS last FROM bars) SELECT symbol, min(date)::VARCHAR AS listing_date, (CASE WHEN max(date) < any_value(last) THEN max(date) END)::VARCHAR AS delist_date FROM bars, e GROUP BY symbol")
def listing_info(spark, sf_dir):
    bars = B.weekly(spark, sf_dir, dealt=False)
    return out(B.listing(bars, F.lit(B.weeks(spark, sf_dir).agg(F.max("date")).first()[0])), "symbol", "listing_date", "delist_date")


@query(f"WITH {B.SQL} SELECT symbol, {D}, contains(s_name, '7') AS st FROM panel JOIN supplier ON s_suppkey = symbol")
def st_flags(spark, sf_dir):
    """Flags from the names; 'ST' stands where the sample's names have a 7."""
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("symbol"), F.regexp_replace("s_name", "7", "ST").alias("name"))
    return out(B.special_treatment(B.weekly_panel(spark, sf_dir), names), "symbol", "date", "st")


@query(f"WITH {B.SQL} SELECT symbol, {D}, {g('coalesce(close, quantile_cont(close, 0.5) OVER (PARTITION BY date))', 'close')} FROM panel")
def median_fill(spark, sf_dir):
    return out(B.median_filled(B.weekly_panel(spark, sf_dir), "close"), "symbol", "date", "close")


@query(f"WITH {B.SQL}, k AS (SELECT symbol, volume, count(*) AS c FROM bars GROUP BY ALL), o AS (SELECT symbol, arg_max(volume, (c, -volume)) AS most FROM k GROUP BY 1) SELECT symbol, {g('most')} FROM o")
def mode_by_symbol(spark, sf_dir):
    """The most frequent volume of each symbol, the smallest of several."""
    k = B.weekly(spark, sf_dir).groupBy("symbol", "volume").agg(F.count(F.lit(1)).alias("c"))
    return out(k.groupBy("symbol").agg(F.max_by("volume", F.struct("c", (-F.col("volume")).alias("v"))).cast("double").alias("most")), "symbol", "most")


@query(f"WITH {B.SQL}, o AS (SELECT symbol, date, amount FROM bars ORDER BY amount DESC, symbol, date LIMIT 100) SELECT symbol, {D}, {g('amount')} FROM o")
def head_rows(spark, sf_dir):
    """The hundred largest bars: the limit is the feature."""
    return out(B.weekly(spark, sf_dir).orderBy(F.desc("amount"), "symbol", "date").limit(100), "symbol", "date", "amount")


@query(f"""WITH {B.SQL}, a AS (SELECT symbol, date, close FROM bars WHERE symbol % 2 = 0), b AS (SELECT symbol, date, volume FROM bars WHERE symbol % 3 = 0) SELECT symbol, {D}, {g('close')}, {g('volume')} FROM a FULL JOIN b USING (symbol, date)""")
def outer_align(spark, sf_dir):
    bars = B.weekly(spark, sf_dir)
    a, b = bars.where("symbol % 2 = 0").select("symbol", "date", "close"), bars.where("symbol % 3 = 0").select("symbol", "date", "volume")
    return out(a.join(b, ["symbol", "date"], "full").withColumn("volume", F.col("volume").cast("double")), "symbol", "date", "close", "volume")


# --- importance by market regime, parameters of one factor, exchanges of members ---

_MARKETS = ("market_vol_20d", "market_turnover_20d")
_REGIME_Z = [f"z{i}" for i in range(len(SCORES))] + ["m0", "m1"]


def _regime_sum(moved: str = "") -> str:
    return " + ".join(f"{('b' if x[0] == 'z' else 'dm') if x == moved else ('a' if x[0] == 'z' else 'd')}.{x}" for x in _REGIME_Z)


_REGIME_V = " UNION ALL ".join(
    [f"SELECT d.regime, '' AS feature, a.label, {_regime_sum()} AS p FROM z a JOIN d ON d.date = a.date"]
    + [f"SELECT d.regime, '{f}', a.label, {_regime_sum(x)} FROM z a JOIN d ON d.date = a.date JOIN z b ON b.date = a.date AND b.o_{x} = a.i" for f, x in zip(SCORES, _REGIME_Z)]
    + [f"SELECT d.regime, '{f}', a.label, {_regime_sum(x)} FROM z a JOIN d ON d.date = a.date JOIN d dm ON dm.regime = d.regime AND dm.o_{x} = d.i" for f, x in zip(_MARKETS, ("m0", "m1"))]
)


@query(f"""{R}, {UNIVERSE}, {LABELS}, {_MARKET}, k AS ({known_sql('AND l.date IN (SELECT date FROM mk WHERE market_vol_20d IS NOT NULL)')}),
z_ AS (SELECT symbol, date, label, {_Z} FROM k), z AS MATERIALIZED ({moved_sql('z_', 'date', 'symbol', _REGIME_Z[:4], f'symbol * 7919 + {EPOCH_DAY} * 104729 + 11')}),
dk AS (SELECT date, any_value(market_vol_20d) AS mv, any_value(market_turnover_20d) AS mt, count(*) AS k, round_even(any_value(market_vol_20d) * 1073741824, 0) AS v FROM k JOIN mk USING (date) GROUP BY date),
dr AS (SELECT *, sum(k) OVER (ORDER BY v) - (sum(k) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM dk),
dz AS (SELECT date, (r > (min(r) OVER () + max(r) OVER ()) / 2.0)::INT AS regime, coalesce((mv - avg(mv) OVER ()) / (stddev_samp(mv) OVER () + 1e-12), 0) AS m0, coalesce((mt - avg(mt) OVER ()) / (stddev_samp(mt) OVER () + 1e-12), 0) AS m1 FROM dr),
d AS MATERIALIZED ({moved_sql('dz', 'regime', 'date', ['m0', 'm1'], f'{EPOCH_DAY} * 104729 + {11 + len(SCORES)}')}), vv AS ({_REGIME_V}), {importance_sql('regime')}
SELECT regime, feature, n, {g('base', 'auc')}, {g('auc', 'auc_permuted')}, {g('(base - auc)', '"drop"')} FROM ui""")
def regime_importance(spark, sf_dir):
    """What each factor and market feature adds to the combined score, in calm and in volatile markets."""
    p, _ = placed_panel(spark, sf_dir)
    market = S.market_features(p.where("ever").withColumn("member", F.col("place").isNotNull()), 20, 52)  # a row a date
    y = Plan(_ROOTS).apply(U.labels(p.drop("fwd").withColumnRenamed("later", "fwd")), keep=("label",))
    return out(MOD.regime_importance(y.join(F.broadcast(market), "date"), list(SCORES), list(_MARKETS)), "regime", "feature", "n", "auc", "auc_permuted", "drop")


#: Lags of alpha055 and shares held, as in the parameter scan.
DELTAS, TOP_SHARES = (2, 3, 4, 5, 6, 8, 10, 15, 20), (0.05, 0.1, 0.15, 0.2)
_DELTA_ROOTS = {f"d{k}": definitions(k)["alpha055"].expr for k in DELTAS}


@query(f"""WITH {B.SQL}, {factor_ctes(_DELTA_ROOTS, 'panel')}, pads AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS pad FROM panel),
r AS MATERIALIZED (SELECT symbol, date, pad / lag(pad) OVER {H} - 1 AS ret FROM pads), {SCHEDULE.format(unit='month')}, sc AS ({' UNION ALL '.join(f'SELECT {k} AS delta, symbol, date, d{k} AS score FROM factors' for k in DELTAS)}),
sh AS (SELECT unnest({list(TOP_SHARES)}::DOUBLE[]) AS share), sr AS (SELECT delta, symbol, rb, count(*) OVER (PARTITION BY delta, rb) AS k, row_number() OVER (PARTITION BY delta, rb ORDER BY score DESC, symbol) AS hi FROM sc JOIN sched ON rb = date WHERE score IS NOT NULL),
wt AS MATERIALIZED (SELECT delta, share, symbol, rb, 1.0::DOUBLE / nl AS w FROM (SELECT *, greatest(1, floor(k * share)) AS nl FROM sr CROSS JOIN sh) WHERE hi <= nl AND k > nl), cl AS (SELECT DISTINCT delta, share FROM sc CROSS JOIN sh),
dly AS (SELECT cl.delta, cl.share, r.symbol, r.date, coalesce(ret, 0) AS x, coalesce(wt.w, 0) AS w FROM r CROSS JOIN cl LEFT JOIN sched s ON r.date > s.rb AND r.date <= s.next LEFT JOIN wt ON wt.rb = s.rb AND wt.symbol = r.symbol AND wt.delta = cl.delta AND wt.share = cl.share),
dw AS (SELECT *, abs(w - lag(w) OVER (PARTITION BY delta, share, symbol ORDER BY date)) AS dw FROM dly), c0 AS (SELECT delta, share, date, sum(w * x) AS gross, avg(x) AS bench, sum(dw) AS turnover FROM dw GROUP BY ALL),
c1 AS (SELECT delta, share, date, bench, gross - CASE WHEN lag(s.rb) OVER (PARTITION BY delta, share ORDER BY date) IS NOT NULL THEN turnover / 2 * 0.00102 ELSE 0 END AS net FROM c0 LEFT JOIN sched s ON s.rb = c0.date),
bt AS MATERIALIZED (SELECT *, product(1 + net) OVER (PARTITION BY delta, share ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM c1), m AS ({metric_sql('bt', 'delta, share')}),
a AS (SELECT delta, share, sqrt(252.0) * avg(net - bench) / stddev_samp(net - bench) AS information_ratio FROM bt GROUP BY ALL)
SELECT delta, {', '.join(map(g, ('share', *_M, 'information_ratio')))} FROM m JOIN a USING (delta, share)""")
def delta_scan(spark, sf_dir):
    """alpha055 with each lag and share held: all parameter sets in one backtest."""
    p = Written(E.padded_returns(Plan(_DELTA_ROOTS).apply(B.weekly_panel(spark, sf_dir), keep=B.FIELDS))).df  # read by each part of the backtest
    scores = p.select("symbol", "date", F.explode(F.array(*(F.struct(F.lit(k).alias("delta"), F.col(f"d{k}").alias("score")) for k in DELTAS))).alias("x")).select("symbol", "date", "x.*")
    c = P.section_scan(p, scores, P.rebalance_dates(p), list(TOP_SHARES))
    active = F.col("net") - F.col("bench")
    a = c.groupBy("delta", "share").agg((F.sqrt(F.lit(252.0)) * F.avg(active) / F.stddev_samp(active)).alias("information_ratio"))
    return out(P.metrics(c, ("delta", "share")).join(a, ["delta", "share"]), "delta", "share", *_M, "information_ratio")


@query(f"""WITH {B.SQL}, {MONTHS}, c AS (SELECT snapshot_date, count(*) AS n, count(*) FILTER (left(lpad((symbol * 7919 % 1000000)::VARCHAR, 6, '0'), 1) = '6') AS sh FROM snaps GROUP BY 1),
o AS (SELECT *, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before, lag(n) OVER (ORDER BY snapshot_date) AS n_before FROM c),
k AS (SELECT o.snapshot_date, count(b.symbol) AS same FROM o JOIN snaps a ON a.snapshot_date = o.snapshot_date LEFT JOIN snaps b ON b.symbol = a.symbol AND b.snapshot_date = o.before GROUP BY 1)
SELECT snapshot_date::VARCHAR AS snapshot_date, sh, n - sh AS sz, {g('(n + n_before - 2 * same) / 2.0', 'churn')} FROM o JOIN k USING (snapshot_date)""")
def exchange_mix(spark, sf_dir):
    """Members by exchange, and half of the changes against the snapshot before."""
    s = snapshots(spark, sf_dir)
    code = F.lpad((F.col("symbol") * 7919 % 1000000).cast("string"), 6, "0")
    order = Window.orderBy("snapshot_date")  # a row a snapshot
    c = s.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"), F.sum(B.exchange_code(code).startswith("sh").cast("long")).alias("sh"))
    c = c.withColumns({"before": F.lag("snapshot_date").over(order), "n_before": F.lag("n").over(order)})
    kept_ = s.join(F.broadcast(c.select("snapshot_date", "before")), "snapshot_date").join(s.select("symbol", F.col("snapshot_date").alias("before")), ["symbol", "before"]).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("same"))
    o = c.join(kept_, "snapshot_date", "left").withColumn("sz", F.col("n") - F.col("sh"))
    return out(o.withColumn("churn", (F.col("n") + F.col("n_before") - 2 * F.coalesce("same", F.lit(0))) / 2.0), "snapshot_date", "sh", "sz", "churn")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
