"""Queries of resampling tests (four block bootstraps, resampled rank correlations), orthogonalisations, a user's own factor, synced bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphas import definitions
from .functions.custom import factor
from .operators import evaluation as E
from .operators import models as M
from .operators import portfolio as P
from .operators import statistics as S
from .plans.oracle import factor_ctes
from .plans.planner import Plan
from .research_queries import _M, D, LCG, R, SCHEDULE, SCORES, TOP, UNIVERSE, base, base_once, bin_cte, g, h, members, metric_sql, out
from .sources import bars as B
from .sources.scratch import Written
from .study_queries import long_shorts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_SERIES = f"""{R}, {', '.join(bin_cte(k, f'bins_{k}') for k in SCORES)}, l AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f"SELECT '{v}' AS factor, date, avg(fwd) FILTER (bin = 4) - avg(fwd) FILTER (bin = 0) - {E.PAIR_COST!r} AS r FROM bins_{k} GROUP BY date" for k, v in SCORES.items())}) WHERE r IS NOT NULL),
ser AS MATERIALIZED (SELECT factor, r, row_number() OVER (PARTITION BY factor ORDER BY date) - 1 AS i FROM l), nn AS (SELECT factor, count(*) AS n, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0) AS observed FROM ser GROUP BY 1)"""


def _samples(reps: int, filled: bool) -> str:
    """Every sample row by row: the blocks' rows joined with the series."""
    blocks, starts, size, cut = ("(n + 19) // 20", "n - 19", "20", "k * 20 + j < n") if filled else ("CASE WHEN n <= 20 THEN n ELSE n // 20 END", "CASE WHEN n <= 20 THEN n ELSE n - 20 END", "CASE WHEN n <= 20 THEN 1 ELSE 20 END", "true")
    return f"""dr AS (SELECT factor, rep, k, n, ({size}) AS size, {LCG.format(x='rep * 7919 + k * 104729 + 42')} % ({starts}) AS st FROM nn, range({reps}) a(rep), LATERAL (SELECT unnest(range({blocks})) AS k) {'WHERE n >= 20' if filled else ''}),
sm AS (SELECT factor, rep, r FROM (SELECT factor, rep, st + j AS i FROM dr, range(20) b(j) WHERE j < size AND {cut}) JOIN ser USING (factor, i)),
bs AS MATERIALIZED (SELECT factor, rep, count(*) AS n, avg(r) AS m, product(1 + r) AS growth, CASE WHEN stddev_pop(r) > 1e-12 THEN avg(r) / stddev_pop(r) * sqrt(252.0) ELSE 0 END AS sharpe FROM sm GROUP BY ALL)"""


def sampled(spark: SparkSession, sf_dir: str, reps: int, how: str) -> DataFrame:
    """(factor, rep, n, growth, sharpe, observed) of the long-short returns of each score."""
    runs = Written(long_shorts(base_once(spark, sf_dir))).df  # a row a factor and date, read several times
    seen = runs.where(F.col("ret").isNotNull()).groupBy("factor").agg((F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252.0))).alias("observed"))
    b = S.block_samples(runs, "ret", "factor", reps, how=how)
    return b.withColumn("sharpe", F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(0.0)).join(F.broadcast(seen), "factor")  # a row a factor


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


@query(f"{_SERIES}, {_samples(10000, True)} SELECT factor, {g('any_value(observed)', 'observed')}, {g('avg(CASE WHEN observed > 0 THEN (sharpe <= 0)::INT ELSE (sharpe >= 0)::INT END)', 'p_value')}, count(*) AS reps FROM bs JOIN (SELECT factor, observed FROM nn) USING (factor) GROUP BY factor")
def bootstrap_filled(spark, sf_dir):
    """Samples as long as the series; the share on the other side of zero."""
    b = sampled(spark, sf_dir, 10_000, S.FILLED)
    p = share(F.when(F.col("observed") > 0, F.col("sharpe") <= 0).otherwise(F.col("sharpe") >= 0))
    return out(b.groupBy("factor").agg(F.first("observed").alias("observed"), p.alias("p_value"), F.count(F.lit(1)).alias("reps")), "factor", "observed", "p_value", "reps")


_CI = "quantile_cont(sharpe, 0.025) AS ci_low, quantile_cont(sharpe, 0.975) AS ci_high"


@query(f"""{_SERIES}, {_samples(1000, True)}, z AS (SELECT factor, any_value(observed) AS observed, avg(sharpe) AS mean, stddev_pop(sharpe) AS deviation, avg((sharpe >= observed)::INT) AS p_value, avg((sharpe > 0)::INT) AS positive, {_CI}, avg((growth > 0)::INT) AS solvent FROM bs JOIN (SELECT factor, observed FROM nn) USING (factor) GROUP BY factor)
SELECT factor, {', '.join(map(g, ('observed', 'mean', 'deviation', 'p_value', 'positive', 'ci_low', 'ci_high', 'solvent')))} FROM z""")
def bootstrap_trimmed(spark, sf_dir):
    """Samples as long as the series; the share that does as well as the series itself, an interval, and the share of
    samples whose compounded value stays above zero."""
    b = sampled(spark, sf_dir, 1000, S.FILLED)
    q = lambda p: F.percentile("sharpe", F.lit(p))
    a = b.groupBy("factor").agg(F.first("observed").alias("observed"), F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("deviation"), share(F.col("sharpe") >= F.col("observed")).alias("p_value"), share(F.col("sharpe") > 0).alias("positive"), q(0.025).alias("ci_low"), q(0.975).alias("ci_high"), share(F.col("growth") > 0).alias("solvent"))
    return out(a, "factor", "observed", "mean", "deviation", "p_value", "positive", "ci_low", "ci_high", "solvent")


@query(f"{_SERIES}, {_samples(1000, False)}, z AS (SELECT factor, any_value(observed) AS observed, avg((sharpe >= observed)::INT) AS p_value, avg((sharpe > 0)::INT) AS positive FROM bs JOIN (SELECT factor, observed FROM nn) USING (factor) GROUP BY factor) SELECT factor, {', '.join(map(g, ('observed', 'p_value', 'positive')))}, p_value < 0.05 AS significant FROM z")
def bootstrap_whole(spark, sf_dir):
    """Samples of whole blocks, shorter than the series; the share that does as well as the series itself."""
    a = sampled(spark, sf_dir, 1000, S.WHOLE).groupBy("factor").agg(F.first("observed").alias("observed"), share(F.col("sharpe") >= F.col("observed")).alias("p_value"), share(F.col("sharpe") > 0).alias("positive"))
    return out(a.withColumn("significant", F.col("p_value") < 0.05), "factor", "observed", "p_value", "positive", "significant")


@query(f"{_SERIES}, {_samples(1000, False)}, z AS (SELECT factor, avg(sharpe) AS mean, median(sharpe) AS median, {_CI}, avg((sharpe <= 0)::INT) AS p_value FROM bs GROUP BY factor) SELECT factor, {', '.join(map(g, ('mean', 'median', 'ci_low', 'ci_high', 'p_value')))} FROM z")
def bootstrap_sign(spark, sf_dir):
    """Samples of whole blocks; the share without gain, and the middle 95 %."""
    q = lambda p: F.percentile("sharpe", F.lit(p))
    a = sampled(spark, sf_dir, 1000, S.WHOLE).groupBy("factor").agg(F.avg("sharpe").alias("mean"), q(0.5).alias("median"), q(0.025).alias("ci_low"), q(0.975).alias("ci_high"), share(F.col("sharpe") <= 0).alias("p_value"))
    return out(a, "factor", "mean", "median", "ci_low", "ci_high", "p_value")


#: The older query of the same samples has its SQL here.
SQL["factor_bootstrap"] = f"{_SERIES}, {_samples(1000, False)} SELECT factor, {g('avg((sharpe <= 0)::INT)', 'p_value')}, {g('avg((sharpe > 0)::INT)', 'positive')} FROM bs GROUP BY factor"
_RANK = "rank() OVER (PARTITION BY symbol, rep ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, rep, {x}) - 1) / 2.0"


@query(f"""{R}, k AS MATERIALIZED (SELECT symbol, date, x, y, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, date, round(sum(close) OVER {h(3)} / 4, 6) AS x, fwd AS y FROM n WHERE close IS NOT NULL) WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT symbol, -1 AS rep, i FROM k WHERE n >= 100 UNION ALL SELECT symbol, rep, {LCG.format(x='rep * 7919 + i * 104729 + 5')} % n FROM k, range(200) a(rep) WHERE n >= 100),
c AS MATERIALIZED (SELECT symbol, rep, corr(a, b) AS ic, count(*) AS n FROM (SELECT symbol, rep, {_RANK.format(x='x')} AS a, {_RANK.format(x='y')} AS b FROM s JOIN (SELECT symbol, i, x, y FROM k) USING (symbol, i)) GROUP BY ALL),
p AS (SELECT symbol, o.ic, o.n, avg((round_even(abs(c.ic) * 1073741824, 0) >= round_even(abs(o.ic) * 1073741824, 0))::INT) AS p_value FROM c JOIN (SELECT symbol, ic, n FROM c WHERE rep = -1) o USING (symbol) WHERE c.rep >= 0 GROUP BY ALL)
SELECT symbol, {g('ic')}, n, {g('p_value')}, p_value < 0.05 / count(*) OVER () AS bonferroni FROM p""")
def series_ic_bootstrap(spark, sf_dir):
    """Each symbol's rank correlation over time of a signal with the next return, against 200 resamples of its rows."""
    b = E.next_returns(base(spark, sf_dir)).where(F.col("close").isNotNull())
    b = b.withColumn("x", F.round(F.sum("close").over(E.history().rowsBetween(-3, 0)) / 4, 6))
    p = S.resampled_ics(b, "x", "fwd", "symbol")
    tests = p.agg(F.count(F.lit(1)).alias("tests"))
    return out(p.crossJoin(F.broadcast(tests)).withColumn("bonferroni", F.col("p_value") < 0.05 / F.col("tests")), "symbol", "ic", "n", "p_value", "bonferroni")


# --- orthogonalisation by date: four ways ---

_K12 = "score IS NOT NULL AND score2 IS NOT NULL"
_RATIO = "CASE WHEN {v} > 0 THEN {c} / {v} ELSE 0 END"


@query(f"""{R}, d2 AS (SELECT date, count(*) AS n2, {_RATIO.format(c='sum(score * score2)', v='sum(score * score)')} AS b FROM r WHERE {_K12} GROUP BY 1),
c2 AS MATERIALIZED (SELECT symbol, r.date, score AS o1, score3, CASE WHEN n2 >= 10 THEN score2 - b * score END AS o2 FROM r LEFT JOIN d2 USING (date)),
d3 AS (SELECT date, count(*) AS n3, sum(o1 * o1) AS v1, sum(o2 * o2) AS v2, sum(o1 * o2) AS v12, sum(o1 * score3) AS w1, sum(o2 * score3) AS w2 FROM c2 WHERE o1 IS NOT NULL AND o2 IS NOT NULL AND score3 IS NOT NULL GROUP BY 1),
c3 AS (SELECT symbol, date, o1, o2, CASE WHEN n3 >= 10 THEN score3 - (w1 * v2 - w2 * v12) / (v1 * v2 - v12 * v12) * o1 - (w2 * v1 - w1 * v12) / (v1 * v2 - v12 * v12) * o2 END AS o3 FROM c2 LEFT JOIN d3 USING (date))
SELECT symbol, {D}, {g('o2')}, {g('o3')}, {g('(o1 + o2 + o3) / 3', 'combined')} FROM c3""")
def orthogonal_chain(spark, sf_dir):
    """Each score less what the ones before it explain, without intercept; and their mean."""
    x = M.orthogonal_chain(base(spark, sf_dir), ["score", "score2", "score3"])
    return out(x.select("symbol", "date", F.col("o_score2").alias("o2"), F.col("o_score3").alias("o3"), ((F.col("o_score") + F.col("o_score2") + F.col("o_score3")) / 3).alias("combined")), "symbol", "date", "o2", "o3", "combined")


@query(f"""{R}, d AS (SELECT date, count(*) AS k, var_pop(score2) AS v1, var_pop(score3) AS v2, covar_pop(score2, score3) AS v12, covar_pop(score2, score) AS w1, covar_pop(score3, score) AS w2, avg(score) AS m0, avg(score2) AS m1, avg(score3) AS m2 FROM r WHERE {_K12} AND score3 IS NOT NULL GROUP BY 1),
f AS (SELECT *, (w1 * v2 - w2 * v12) / (v1 * v2 - v12 * v12) AS b1, (w2 * v1 - w1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM d WHERE v1 * v2 - v12 * v12 > 1e-12 * v1 * v2)
SELECT symbol, {D}, {g('CASE WHEN k >= 20 THEN score - m0 - b1 * (score2 - m1) - b2 * (score3 - m2) END', 'residual')} FROM r JOIN f USING (date) WHERE {_K12} AND score3 IS NOT NULL""")
def orthogonal_intercept(spark, sf_dir):
    """The score less its regression with intercept on two others."""
    x = base(spark, sf_dir).dropna(subset=["score", "score2", "score3"])
    return out(M.orthogonal_to(x, "score", ["score2", "score3"], least=20), "symbol", "date", "residual")


@query(f"{R}, d AS (SELECT date, count(*) AS k, {_RATIO.format(c='covar_pop(score2, score)', v='var_pop(score2)')} AS b FROM r WHERE {_K12} GROUP BY 1) SELECT symbol, {D}, {g('CASE WHEN k >= 20 THEN score - b * score2 ELSE score END', 'residual')} FROM r JOIN d USING (date) WHERE {_K12}")
def orthogonal_slope(spark, sf_dir):
    """The score less slope times the other, the constant left in; the score itself on dates with fewer than 20 names."""
    x = base(spark, sf_dir).dropna(subset=["score", "score2"])
    return out(M.orthogonal_to(x, "score", ["score2"], least=20, keep=True, constant=False), "symbol", "date", "residual")


# --- a factor from a user's text, bars with coverage ---


@query(f"WITH {B.SQL}, {factor_ctes({'alpha055': definitions(10)['alpha055'].expr}, 'panel')} SELECT symbol, {D}, {g('alpha055', 'value')} FROM factors")
def custom_factor(spark, sf_dir):
    """A factor that a user writes down, with a parameter."""
    own = factor("value", "-RANK(ABS(DELTA(C, days))) * RANK(DELTA(V, days))", days=10)
    return out(Plan({own.name: own.expr}).apply(B.weekly_panel(spark, sf_dir)), "symbol", "date", "value")


_FROM, _TO, _CUT, _NEW = "1995-06-01", "1999-12-31", "1998-01-01", 10


@query(f"""WITH {B.SQL}, old AS (SELECT * FROM bars WHERE date < '{_CUT}' AND date >= '1996-01-01' AND symbol IN (SELECT symbol FROM bars WHERE date = (SELECT min(date) FROM bars))),
cover AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM old GROUP BY 1), fresh AS (SELECT symbol FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol NOT IN (SELECT symbol FROM cover) ORDER BY symbol LIMIT {_NEW}),
added AS (SELECT b.symbol, b.date, 'new' AS part FROM bars b JOIN fresh USING (symbol) WHERE date BETWEEN '{_FROM}' AND '{_TO}' UNION ALL SELECT b.symbol, b.date, CASE WHEN b.date < lo THEN 'before' ELSE 'after' END FROM bars b JOIN cover USING (symbol) WHERE date BETWEEN '{_FROM}' AND '{_TO}' AND (b.date < lo OR b.date > hi))
SELECT symbol, count(*) AS n_rows, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date, count(*) FILTER (part = 'new') AS n_new, count(*) FILTER (part <> 'new') AS n_added FROM (SELECT symbol, date, 'old' AS part FROM old UNION ALL FROM added SELECT symbol, date, part) GROUP BY 1""".replace("count(*) FILTER (part <> 'new')", "count(*) FILTER (part IN ('before', 'after'))"))
def sync_missing(spark, sf_dir):
    """Stored bars brought up to a range of dates: symbols that are stored get what they lack at both ends, of the others
    ten are added."""
    bars = B.weekly(spark, sf_dir, dealt=False)
    first = B.weeks(spark, sf_dir).agg(F.min("date").alias("date"))
    old = bars.where(F.col("date").between(F.lit("1996-01-01").cast("date"), F.date_sub(F.lit(_CUT).cast("date"), 1))).join(bars.join(F.broadcast(first), "date").select("symbol"), "symbol", "left_semi")
    new = B.fetched(old, bars, bars, _FROM, _TO, _NEW)
    had = old.select("symbol").distinct().withColumn("_had", F.lit(1))
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).join(had, "symbol", "left")
    s = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"), F.count(F.when((F.col("_new") == 1) & F.col("_had").isNull(), 1)).alias("n_new"), F.count(F.when((F.col("_new") == 1) & F.col("_had").isNotNull(), 1)).alias("n_added"))
    return out(s, "symbol", "n_rows", "first_date", "last_date", "n_new", "n_added")


# --- two universes in one backtest ---


@query(f"""{R}, {UNIVERSE}, {SCHEDULE.format(unit='month')}, sc AS (SELECT 'fixed' AS universe, symbol, date, score FROM u WHERE symbol <= {TOP} UNION ALL SELECT 'point_in_time', symbol, date, score FROM u WHERE member),
sr AS (SELECT universe, symbol, rb, count(*) OVER (PARTITION BY universe, rb) AS k, row_number() OVER (PARTITION BY universe, rb ORDER BY score DESC, symbol) AS hi FROM sc JOIN sched ON rb = date WHERE score IS NOT NULL),
wt AS MATERIALIZED (SELECT universe, symbol, rb, 1.0::DOUBLE / nl AS w FROM (SELECT *, greatest(1, floor(k * 0.2)) AS nl FROM sr) WHERE hi <= nl AND k > nl), cl AS (SELECT DISTINCT universe FROM sc),
dly AS (SELECT cl.universe, r.symbol, r.date, coalesce(ret, 0) AS x, coalesce(wt.w, 0) AS w FROM r CROSS JOIN cl LEFT JOIN sched s ON r.date > s.rb AND r.date <= s.next LEFT JOIN wt ON wt.rb = s.rb AND wt.symbol = r.symbol AND wt.universe = cl.universe),
dw AS (SELECT *, abs(w - lag(w) OVER (PARTITION BY universe, symbol ORDER BY date)) AS dw FROM dly), c0 AS (SELECT universe, date, sum(w * x) AS gross, sum(dw) AS turnover FROM dw GROUP BY ALL),
c1 AS (SELECT universe, date, gross - CASE WHEN lag(s.rb) OVER (PARTITION BY universe ORDER BY date) IS NOT NULL THEN turnover / 2 * 0.00102 ELSE 0 END AS net FROM c0 LEFT JOIN sched s ON s.rb = c0.date),
bt AS MATERIALIZED (SELECT *, product(1 + net) OVER (PARTITION BY universe ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM c1), m AS ({metric_sql('bt', 'universe')}) SELECT universe, {', '.join(map(g, _M))} FROM m""")
def universe_bias_backtest(spark, sf_dir):
    """The best fifth by score, held monthly: of the first names by symbol, and of each date's own members."""
    p = Written(members(spark, sf_dir)).df
    of = F.array_compact(F.array(F.when(F.col("symbol") <= TOP, F.lit("fixed")), F.when(F.col("member"), F.lit("point_in_time"))))
    scores = p.select("symbol", "date", F.explode(of).alias("universe"), "score")
    c = P.section_scan(p, scores, P.rebalance_dates(p), [0.2], ("universe",))
    return out(P.metrics(c, ("universe",)), "universe", *_M)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
