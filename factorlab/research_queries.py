"""Queries of the research operators: evaluation, universes, labels, backtests, statistics; with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .factor_queries import kept
from .functions.alphas import definitions
from .operators import evaluation as E
from .operators import models as MOD
from .operators import portfolio as P
from .operators import statistics as S
from .operators import universe as U
from .plans.oracle import factor_ctes, rounded
from .plans.planner import Plan
from .sources import bars as B
from .sources.scratch import Written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Factors that the evaluation queries score with: the first is the main one.
SCORES = {"score": "alpha055", "score2": "alpha094", "score3": "alpha014", "score4": "alpha018"}
_ROOTS = {k: definitions()[v].expr for k, v in SCORES.items()}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def out(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, dates as text, doubles on the grid that any engine rounds to."""
    kind = dict(df.dtypes)
    return df.select(*(F.col(c).cast("string").alias(c) if kind[c] == "date" else kept(F.col(c)).alias(c) if kind[c] == "double" else F.col(c) for c in columns))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with scores and returns; these come first, since ranks leave the rows by date."""
    p = Plan(_ROOTS).apply(E.padded_returns(B.weekly_panel(spark, sf_dir)), keep=(*B.FIELDS, "ret"))
    return p.select("symbol", "date", *B.FIELDS, *_ROOTS, "ret")


def base_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base() as a written table, for queries that read it several times."""
    return Written(base(spark, sf_dir)).df


H = "(PARTITION BY symbol ORDER BY date)"


def h(rows: int, last: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {rows} PRECEDING AND {last})"


R = f"""WITH {B.SQL}, {factor_ctes(_ROOTS, 'panel')},
pads AS (SELECT p.*, {', '.join(_ROOTS)}, last_value(close IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.date ROWS UNBOUNDED PRECEDING) AS pad
  FROM panel p JOIN factors f ON f.symbol = p.symbol AND f.date = p.date),
r AS MATERIALIZED (SELECT * EXCLUDE pad, pad / lag(pad) OVER {H} - 1 AS ret FROM pads),
n AS MATERIALIZED (SELECT *, coalesce(lead(coalesce(ret, 0)) OVER {H}, 0) AS fwd FROM r),
n5 AS MATERIALIZED (SELECT *, lead(close, 6) OVER {H} / lead(close, 1) OVER {H} - 1 AS fwd FROM r)
"""
D = "date::VARCHAR AS date"


def g(x: str, name: str | None = None) -> str:
    return f"{rounded(x)} AS {name or x}"


def ranks(x: str) -> str:
    return f"rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"


def ic_cte(score: str = "score", name: str = "ic", source: str = "n") -> str:
    return f"""{name} AS MATERIALIZED (SELECT date, corr(a, b) AS ic FROM (SELECT date, {ranks(score)} AS a, {ranks('fwd')} AS b FROM {source} WHERE {score} IS NOT NULL AND fwd IS NOT NULL)
  GROUP BY date HAVING count(*) >= 10 AND min(a) < max(a) AND min(b) < max(b))"""


def fm_cte(score: str = "score", name: str = "fm", source: str = "n") -> str:
    return f"{name} AS MATERIALIZED (SELECT date, covar_samp({score}, fwd) / var_pop({score}) AS slope FROM {source} WHERE {score} IS NOT NULL AND fwd IS NOT NULL GROUP BY date HAVING count(*) >= 10 AND var_pop({score}) >= 1e-12)"


def bin_cte(score: str = "score", name: str = "bins", source: str = "n", more: str = "AND fwd IS NOT NULL") -> str:
    return f"""{name} AS MATERIALIZED (SELECT s.*, greatest(len(list_filter(list_distinct(e), lambda x: x < {score} - 1e-9)) - 1, 0) AS bin FROM {source} s
  JOIN (SELECT date, quantile_cont({score}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM {source} WHERE {score} IS NOT NULL {more} GROUP BY date HAVING count(*) >= 15) q USING (date) WHERE {score} IS NOT NULL {more})"""


QUANTILES = "quintiles AS MATERIALIZED (SELECT date, " + ", ".join(f"avg(fwd) FILTER (bin = {k}) AS q{k + 1}" for k in range(5)) + " FROM bins GROUP BY date)"
SUMMARY = "avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, count(ic) AS ic_days, avg((ic > 0)::INT) AS positive_ratio, avg(ic) / nullif(stddev_pop(ic), 0) AS ic_ir, avg(ic) / nullif(stddev_pop(ic), 0) * sqrt(count(ic)) AS ic_t"


@query(f"{R} SELECT symbol, {D}, {g('fwd')} FROM n")
def fwd_return(spark, sf_dir):
    return out(E.next_returns(base(spark, sf_dir)), "symbol", "date", "fwd")


@query(f"{R} SELECT symbol, {D}, {g('fwd')} FROM n5")
def horizon_return(spark, sf_dir):
    return out(E.horizon_returns(base(spark, sf_dir)), "symbol", "date", "fwd")


@query(f"{R}, {ic_cte()} SELECT {D}, {g('ic')} FROM ic")
def rank_ic_daily(spark, sf_dir):
    return out(E.rank_ic(E.next_returns(base(spark, sf_dir))), "date", "ic")


@query(f"{R}, {ic_cte()}, s AS (SELECT {SUMMARY} FROM ic) SELECT ic_days, {', '.join(map(g, ('ic_mean', 'ic_std', 'positive_ratio', 'ic_ir', 'ic_t')))} FROM s")
def ic_summary(spark, sf_dir):
    return out(E.ic_summary(E.rank_ic(E.next_returns(base(spark, sf_dir)))), "ic_days", "ic_mean", "ic_std", "positive_ratio", "ic_ir", "ic_t")


@query(f"{R}, {fm_cte()}, s AS (SELECT avg(slope) * 252 AS lambda_annual, avg(slope) / nullif(stddev_pop(slope), 0) * sqrt(count(*)) AS fm_t, count(*) AS fm_days FROM fm) SELECT {g('lambda_annual')}, {g('fm_t')}, fm_days FROM s")
def fama_macbeth(spark, sf_dir):
    return out(E.fama_macbeth(E.fama_macbeth_daily(E.next_returns(base(spark, sf_dir)))), "lambda_annual", "fm_t", "fm_days")


@query(f"{R}, {bin_cte(more='')}, d AS (SELECT date, (count(DISTINCT bin) = 5)::INT AS f FROM bins GROUP BY date), s AS (SELECT avg(f) AS cs_effective_ratio, count(*) AS cs_days FROM d) SELECT {g('cs_effective_ratio')}, cs_days FROM s")
def cs_effective_ratio(spark, sf_dir):
    return out(E.effective_ratio(E.next_returns(base(spark, sf_dir))), "cs_effective_ratio", "cs_days")


@query(f"{R}, {bin_cte()}, {QUANTILES} SELECT {D}, {', '.join(g(f'q{k}') for k in range(1, 6))} FROM quintiles")
def quintile_returns(spark, sf_dir):
    return out(E.quantile_returns(E.next_returns(base(spark, sf_dir))), "date", *(f"q{k}" for k in range(1, 6)))


CURVE = f"{QUANTILES}, ls AS (SELECT date, q5 - q1 - {E.PAIR_COST!r} AS ls_ret FROM quintiles), curve AS (SELECT date, ls_ret, product(1 + coalesce(ls_ret, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS ls_cum FROM ls)"


@query(f"{R}, {bin_cte()}, {CURVE} SELECT {D}, {g('ls_ret')}, {g('ls_cum')} FROM curve")
def long_short_curve(spark, sf_dir):
    return out(E.long_short_curve(E.quantile_returns(E.next_returns(base(spark, sf_dir)))), "date", "ls_ret", "ls_cum")


@query(f"{R}, {bin_cte()}, d AS (SELECT " + ", ".join(f"avg(fwd) FILTER (bin = {k}) AS m{k}" for k in range(5)) + f" FROM bins) SELECT (m0 < m1 AND m1 < m2 AND m2 < m3 AND m3 < m4) AS monotone, {', '.join(g(f'm{k}') for k in range(5))} FROM d")
def monotonicity(spark, sf_dir):
    b = E.binned(E.next_returns(base(spark, sf_dir)).where(F.col("fwd").isNotNull()))
    d = b.agg(*(F.avg(F.when(F.col("bin") == k, F.col("fwd"))).alias(f"m{k}") for k in range(5)))
    rising = [F.col(f"m{k}") < F.col(f"m{k + 1}") for k in range(4)]
    return out(d.withColumn("monotone", rising[0] & rising[1] & rising[2] & rising[3]), "monotone", *(f"m{k}" for k in range(5)))


def all_metrics(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(factor, metrics) and (factor, date, ic) of all scores, by one pass over a long frame."""
    long = E.next_returns(panel).select("symbol", F.col("date").alias("d"), "fwd", F.explode(F.array(*(F.struct(F.lit(v).alias("factor"), F.col(k).alias("score")) for k, v in SCORES.items()))).alias("x"))
    long = long.select("symbol", F.struct("x.factor", "d").alias("date"), "fwd", "x.score")  # a day of one factor is a section
    named = lambda df, *c: df.select(F.col("date.factor").alias("factor"), F.col("date.d").alias("date"), *c)
    ics = named(E.rank_ic(long), "ic")
    bins = named(E.binned(long).groupBy("date").agg((F.countDistinct("bin") == 5).cast("double").alias("full")), "full")
    m = E.ic_summary(ics, ("factor",)).join(E.fama_macbeth(named(E.fama_macbeth_daily(long), "slope"), ("factor",)), "factor").join(bins.groupBy("factor").agg(F.avg("full").alias("cs_effective_ratio")), "factor")
    return E.gates(m), ics


_METRICS = ", ".join(f"{ic_cte(k, f'ic_{k}')}, {fm_cte(k, f'fm_{k}')}, {bin_cte(k, f'bins_{k}', more='')}" for k in SCORES)
_PURIFY = " UNION ALL ".join(f"""SELECT '{v}' AS factor, (SELECT avg(ic) / nullif(stddev_pop(ic), 0) FROM ic_{k}) AS ic_ir, (SELECT avg(slope) / nullif(stddev_pop(slope), 0) * sqrt(count(*)) FROM fm_{k}) AS fm_t,
  (SELECT avg(f) FROM (SELECT (count(DISTINCT bin) = 5)::INT AS f FROM bins_{k} GROUP BY date)) AS cs_effective_ratio""" for k, v in SCORES.items())


@query(f"{R}, {_METRICS}, m AS ({_PURIFY}) SELECT factor, {g('ic_ir')}, {g('fm_t')}, {g('cs_effective_ratio')}, coalesce(abs(ic_ir) > 0.05 AND abs(fm_t) > 2 AND cs_effective_ratio > 0.5, false) AS passed FROM m")
def purify(spark, sf_dir):
    return out(all_metrics(base_once(spark, sf_dir))[0], "factor", "ic_ir", "fm_t", "cs_effective_ratio", "passed")


_ICS = ", ".join(ic_cte(k, f"ic_{k}") for k in SCORES) + ", ics AS (" + " UNION ALL ".join(f"SELECT '{v}' AS factor, date, ic FROM ic_{k}" for k, v in SCORES.items()) + f"), whole AS (SELECT * FROM ics WHERE date IN (SELECT date FROM ics GROUP BY date HAVING count(*) = {len(SCORES)}))"


@query(f"{R}, {_ICS}, c AS (SELECT a.factor AS factor_a, b.factor AS factor_b, corr(a.ic, b.ic) AS corr FROM whole a JOIN whole b USING (date) GROUP BY ALL) SELECT factor_a, factor_b, {g('corr')} FROM c")
def ic_corr(spark, sf_dir):
    ics = Written(all_metrics(base_once(spark, sf_dir))[1]).df  # read several times
    return out(E.ic_correlation(ics), "factor_a", "factor_b", "corr")


@query()
def greedy_pool(spark, sf_dir):
    metrics, ics = all_metrics(base_once(spark, sf_dir))
    ics = Written(ics).df
    corr = {(r["factor_a"], r["factor_b"]): r["corr"] for r in E.ic_correlation(ics).collect()}  # factors squared
    kept_ = E.greedy_pool([(r["factor"], r["ic_ir"]) for r in metrics.collect()], corr, most=0.3)
    return spark.createDataFrame([(i, f) for i, f in enumerate(kept_)], "place int, factor string")


_Z = ", ".join(f"({k} - avg({k}) OVER (PARTITION BY date)) / (stddev_samp({k}) OVER (PARTITION BY date) + 1e-12) AS z{i}" for i, k in enumerate(SCORES))


@query(f"{R}, z AS (SELECT symbol, date, {_Z} FROM r), c AS (SELECT symbol, date, (z0 + z1 + z2 + z3) / 4 AS combined FROM z) SELECT symbol, {D}, {g('combined')} FROM c")
def zscore_combine(spark, sf_dir):
    z = E.zscores(base(spark, sf_dir), list(SCORES))
    return out(z.withColumn("combined", E.combined(z, dict.fromkeys(SCORES, 1.0))), "symbol", "date", "combined")


@query(f"""{R}, {_METRICS}, m AS ({_PURIFY}), w AS (SELECT factor, ic_ir / (SELECT sum(abs(ic_ir)) FROM m) AS w FROM m), z AS (SELECT symbol, date, {_Z} FROM r),
c AS (SELECT symbol, date, {' + '.join(f"z{i} * (SELECT w FROM w WHERE factor = '{v}')" for i, v in enumerate(SCORES.values()))} AS combined FROM z) SELECT symbol, {D}, {g('combined')} FROM c""")
def icir_combine(spark, sf_dir):
    p = base_once(spark, sf_dir)
    ir = {r["factor"]: r["ic_ir"] for r in all_metrics(p)[0].select("factor", "ic_ir").collect()}  # a row a factor
    z = E.zscores(p, list(SCORES))
    return out(z.withColumn("combined", E.combined(z, {k: ir[v] for k, v in SCORES.items()})), "symbol", "date", "combined")


@query(f"""{R}, b AS (SELECT *, CASE WHEN score IS NOT NULL AND score2 IS NOT NULL THEN score2 END AS u, CASE WHEN score IS NOT NULL AND score2 IS NOT NULL THEN score END AS v FROM r),
s AS (SELECT date, count(u) AS n, avg(u) AS mu, avg(v) AS mv, CASE WHEN min(u) < max(u) THEN covar_pop(v, u) / var_pop(u) ELSE 0 END AS k FROM b GROUP BY date),
o AS (SELECT symbol, date, CASE WHEN n >= 20 THEN v - (mv + k * (u - mu)) ELSE v END AS residual FROM b JOIN s USING (date)) SELECT symbol, {D}, {g('residual')} FROM o""")
def orthogonal_residual(spark, sf_dir):
    return out(E.orthogonal(base(spark, sf_dir), "score", "score2"), "symbol", "date", "residual")


@query(f"""{R}, m0 AS (SELECT symbol, date, coalesce(ret, 0) AS x, avg(coalesce(ret, 0)) OVER (PARTITION BY date) AS m FROM r),
m1 AS (SELECT *, CASE WHEN count(x) OVER {h(251)} >= 120 AND var_samp(m) OVER {h(251)} > 0 THEN covar_samp(x, m) OVER {h(251)} / var_samp(m) OVER {h(251)} END AS beta FROM m0),
m2 AS (SELECT *, x - beta * m AS e FROM m1), m3 AS (SELECT symbol, date, CASE WHEN count(e) OVER {h(59)} >= 60 THEN sum(e) OVER {h(59)} END AS momentum FROM m2) SELECT symbol, {D}, {g('momentum')} FROM m3""")
def residual_momentum(spark, sf_dir):
    return out(S.residual_momentum(base(spark, sf_dir).select("symbol", "date", "ret")), "symbol", "date", "momentum")


@query(f"{R}, m AS (SELECT symbol, date, CASE WHEN count(close) OVER {h(251)} >= 60 THEN close / max(close) OVER {h(251)} END AS nearness FROM r) SELECT symbol, {D}, {g('nearness')} FROM m")
def high_52w(spark, sf_dir):
    return out(S.high_52w(base(spark, sf_dir)), "symbol", "date", "nearness")


TOP = 30
UNIVERSE = f"""u0 AS (SELECT *, sum((date >= first_date)::INT) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS listed,
  CASE WHEN count(amount) OVER {h(19)} >= 5 THEN avg(amount) OVER {h(19)} END AS mean_amount FROM (SELECT *, min(date) FILTER (close IS NOT NULL) OVER (PARTITION BY symbol) AS first_date FROM r)),
u1 AS (SELECT *, CASE WHEN listed >= 52 AND coalesce(volume, 1) > 0 AND close IS NOT NULL THEN round_even(mean_amount * 128, 0) / 128 END AS am FROM u0),
u AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY date ORDER BY am DESC NULLS LAST, symbol) <= {TOP} AND am IS NOT NULL AND count(am) OVER (PARTITION BY date) >= {TOP}) AS member FROM u1)"""


def placed_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The panel as a written table, with ret, fwd (next row), later (the five rows after the next), `place` (of a date's members)
    and `ever` (whether a symbol is a member on any date); and (symbol, date, place) of the members, a written table."""
    panel = E.padded_returns(B.weekly_panel(spark, sf_dir))
    panel = U.traded_amounts(E.next_returns(E.horizon_returns(panel).withColumnRenamed("fwd", "later")), 20, 52)
    amounts = Written(panel)
    places = Written(U.liquid_places(amounts.df, TOP)).df  # TOP rows a date at most
    p = amounts.df.drop("_amount").join(F.broadcast(places.withColumn("place", F.col("place").cast("double"))), ["symbol", "date"], "left")
    p = p.join(F.broadcast(places.select("symbol", F.lit(True).alias("ever")).distinct()), "symbol", "left").withColumn("ever", F.coalesce("ever", F.lit(False)))
    return p, places


def members(spark, sf_dir):
    return U.liquid(base(spark, sf_dir), TOP, 20, 52)


@query(f"{R}, {UNIVERSE} SELECT symbol, {D}, member FROM u")
def universe_dynamic(spark, sf_dir):
    return out(members(spark, sf_dir), "symbol", "date", "member")


@query(f"""{R}, {UNIVERSE}, v AS (SELECT date, member, CASE WHEN count(ret) OVER {h(19)} = 20 THEN stddev_samp(ret) OVER {h(19)} END AS vol,
  CASE WHEN count(volume) OVER {h(19)} = 20 THEN avg(volume) OVER {h(19)} END / CASE WHEN count(volume) OVER {h(51)} = 52 THEN avg(volume) OVER {h(51)} END AS t FROM u),
m AS (SELECT date, avg(vol) FILTER (member) AS market_vol_20d, avg(t) FILTER (member) AS market_turnover_20d FROM v GROUP BY date) SELECT {D}, {g('market_vol_20d')}, {g('market_turnover_20d')} FROM m""")
def market_features(spark, sf_dir):
    return out(S.market_features(members(spark, sf_dir), 20, 52), "date", "market_vol_20d", "market_turnover_20d")


def fundamentals(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("symbol"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("q"), "l_extendedprice")
    q = q.groupBy("symbol", "q").agg(F.round(F.sum("l_extendedprice"), 2).alias("value")).withColumn("period_end", F.date_sub(F.add_months("q", 3), 1))
    published = F.when(F.col("symbol") % 3 != 0, F.date_add("period_end", 30))
    return q.withColumn("effective_date", U.effective_date(published, F.col("period_end")))


FUND = """fund AS (SELECT symbol, value, period_end, (coalesce(CASE WHEN symbol % 3 <> 0 THEN period_end + 30 END,
  CASE quarter(period_end) WHEN 1 THEN make_date(year(period_end), 5, 1) WHEN 2 THEN make_date(year(period_end), 9, 1) WHEN 3 THEN make_date(year(period_end), 11, 1) ELSE make_date(year(period_end) + 1, 5, 1) END) + 1)::DATE AS effective_date
  FROM (SELECT l_suppkey AS symbol, round(sum(l_extendedprice), 2) AS value, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE - 1 AS period_end FROM lineitem GROUP BY 1, 3)),
fundd AS (SELECT symbol, effective_date, max(value) AS value FROM fund GROUP BY ALL)"""


@query(f"WITH {B.SQL}, {FUND} SELECT p.symbol, p.date::VARCHAR AS date, {g('f.value', 'value')} FROM panel p ASOF LEFT JOIN fundd f ON p.symbol = f.symbol AND p.date >= f.effective_date")
def asof_fundamentals(spark, sf_dir):
    p = B.weekly_panel(spark, sf_dir).select("symbol", "date")
    return out(U.as_of(p, fundamentals(spark, sf_dir), "value"), "symbol", "date", "value")


@query(f"WITH {FUND} SELECT symbol, period_end::VARCHAR AS period_end, effective_date::VARCHAR AS effective_date, {g('value')} FROM fund")
def effective_dates(spark, sf_dir):
    return out(fundamentals(spark, sf_dir), "symbol", "period_end", "effective_date", "value")


MONTHS = f"months AS (SELECT symbol, date_trunc('month', date) AS m, round(sum(amount), 2) AS a FROM bars GROUP BY 1, 2), ends AS (SELECT date_trunc('month', date) AS m, max(date) AS snapshot_date FROM bars GROUP BY 1), snaps AS (SELECT symbol, snapshot_date FROM (SELECT symbol, m, row_number() OVER (PARTITION BY m ORDER BY a DESC, symbol) AS k FROM months) JOIN ends USING (m) WHERE k <= {TOP} AND month(snapshot_date) % 3 = 0)"


def snapshots(spark, sf_dir):
    bars = B.weekly(spark, sf_dir).withColumn("m", F.date_trunc("month", "date"))
    top = bars.groupBy("symbol", "m").agg(F.round(F.sum("amount"), 2).alias("a")).withColumn("k", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("a"), "symbol"))).where(F.col("k") <= TOP)
    return top.join(bars.groupBy("m").agg(F.max("date").alias("snapshot_date")), "m").where(F.month("snapshot_date") % 3 == 0).select("symbol", "snapshot_date")


@query(f"""WITH {B.SQL}, {MONTHS}, grid AS (SELECT s.symbol, d.snapshot_date, x.symbol IS NOT NULL AS member FROM (SELECT DISTINCT symbol FROM snaps) s CROSS JOIN (SELECT DISTINCT snapshot_date FROM snaps) d LEFT JOIN snaps x ON x.symbol = s.symbol AND x.snapshot_date = d.snapshot_date),
a AS (SELECT p.symbol, p.date, g.member FROM panel p ASOF LEFT JOIN grid g ON p.symbol = g.symbol AND p.date >= g.snapshot_date),
f AS (SELECT symbol, min_by(member, snapshot_date) AS member FROM grid GROUP BY 1) SELECT a.symbol, a.date::VARCHAR AS date, coalesce(a.member, f.member, false) AS member FROM a LEFT JOIN f USING (symbol)""")
def membership_daily(spark, sf_dir):
    return out(U.daily_membership(B.weekly_panel(spark, sf_dir), snapshots(spark, sf_dir)), "symbol", "date", "member")


@query(f"""WITH {B.SQL}, {MONTHS}, last AS (SELECT symbol FROM snaps WHERE snapshot_date = (SELECT max(snapshot_date) FROM snaps)),
c AS (SELECT s.snapshot_date, count(*) AS n, avg((l.symbol IS NOT NULL)::INT) AS coverage FROM snaps s LEFT JOIN last l USING (symbol) GROUP BY 1),
o AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM c),
k AS (SELECT o.snapshot_date, count(b.symbol) AS same, any_value(before) AS before FROM o JOIN snaps a ON a.snapshot_date = o.snapshot_date LEFT JOIN snaps b ON b.symbol = a.symbol AND b.snapshot_date = o.before GROUP BY 1)
SELECT c.snapshot_date::VARCHAR AS snapshot_date, c.n, {g('coverage')}, CASE WHEN before IS NOT NULL THEN c.n - same END AS entered FROM c JOIN k USING (snapshot_date)""")
def survivor_coverage(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    dates = s.select("snapshot_date").distinct().withColumn("before", F.lag("snapshot_date").over(Window.orderBy("snapshot_date")))
    last = s.join(s.agg(F.max("snapshot_date").alias("snapshot_date")), "snapshot_date").select("symbol", F.lit(1).alias("stays"))
    previous = s.select("symbol", F.col("snapshot_date").alias("before"), F.lit(1).alias("was"))
    d = s.join(F.broadcast(dates), "snapshot_date").join(last, "symbol", "left").join(previous, ["symbol", "before"], "left")
    d = d.groupBy("snapshot_date", "before").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("stays", F.lit(0))).alias("coverage"), F.count("was").alias("same"))
    return out(d.withColumn("entered", F.when(F.col("before").isNotNull(), F.col("n") - F.col("same"))), "snapshot_date", "n", "coverage", "entered")


LABELS = f"""lab AS MATERIALIZED (SELECT s.symbol, s.date, s.fwd, s.score, CASE WHEN n >= 5 AND fwd IS NOT NULL THEN CASE WHEN fwd <= e[1] + 1e-12 THEN 0 WHEN fwd >= e[2] - 1e-12 THEN 1 END END AS label
  FROM n5 s JOIN (SELECT date, quantile_cont(fwd, [0.2, 0.8]) AS e, count(fwd) AS n FROM n5 GROUP BY date) q USING (date))"""


def labelled(spark, sf_dir):
    return U.labels(E.horizon_returns(base(spark, sf_dir)))


@query(f"{R}, {LABELS} SELECT symbol, {D}, label FROM lab")
def labels(spark, sf_dir):
    return out(labelled(spark, sf_dir), "symbol", "date", "label")


@query(f"{R}, {LABELS} SELECT symbol, {D}, label, {g('score')} FROM lab WHERE label IS NOT NULL")
def aligned_samples(spark, sf_dir):
    p = base(spark, sf_dir)
    y = U.labels(E.horizon_returns(p)).where(F.col("label").isNotNull()).select("symbol", "date", "label")
    return out(p.select("symbol", "date", "score").join(y, ["symbol", "date"]), "symbol", "date", "label", "score")


@query(f"{R}, {LABELS}, w AS (SELECT symbol, date, label, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)) AS weight FROM lab WHERE label IS NOT NULL) SELECT symbol, {D}, label, {g('weight')} FROM w")
def sample_weights(spark, sf_dir):
    return out(U.balanced_weights(labelled(spark, sf_dir)), "symbol", "date", "label", "weight")


def fold_sql(source: str, order: str) -> str:
    return f"""n_ AS (SELECT count(*) AS n FROM {source}), f AS (SELECT k::INT AS fold, floor(n * (k + 1) / 6.0)::BIGINT - 6 AS train_end, floor(n * (k + 1) / 6.0)::BIGINT AS s, floor(n * (k + 2) / 6.0)::BIGINT AS e FROM n_, range(5) t(k)),
at_ AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM {source}),
p_ AS (SELECT fold, at_.*, CASE WHEN i < train_end THEN 'train' WHEN i >= s AND i < e THEN 'validation' END AS part FROM at_ CROSS JOIN f)"""


@query(f"{R}, {LABELS}, days AS (SELECT DISTINCT date FROM lab WHERE label IS NOT NULL), {fold_sql('days', 'date')} SELECT fold, part, {D}, symbol FROM p_ JOIN lab USING (date) WHERE label IS NOT NULL AND part IS NOT NULL")
def purged_folds(spark, sf_dir):
    return out(U.placed_in_folds(labelled(spark, sf_dir).where(F.col("label").isNotNull())), "fold", "part", "date", "symbol")


@query(f"{R}, {LABELS}, known AS (SELECT date, symbol FROM lab WHERE label IS NOT NULL), {fold_sql('known', 'date, symbol')} SELECT fold, part, {D}, symbol FROM p_ WHERE part IS NOT NULL")
def purged_folds_rows(spark, sf_dir):
    return out(U.placed_in_folds(labelled(spark, sf_dir).where(F.col("label").isNotNull()), unit="row"), "fold", "part", "date", "symbol")


@query(f"""{R}, {LABELS}, y AS (SELECT year(date) AS y, symbol, date, score, label FROM lab WHERE label IS NOT NULL AND score IS NOT NULL),
t AS (SELECT a.y AS test_year, count(*) FILTER (b.y < a.y) AS n_train, count(*) FILTER (b.y = a.y) AS n_test FROM (SELECT DISTINCT y FROM y) a JOIN y b ON b.y <= a.y GROUP BY 1) SELECT test_year::INT AS test_year, n_train, n_test FROM t WHERE n_train >= 1000 AND n_test >= 100""")
def walk_forward_years(spark, sf_dir):
    y = labelled(spark, sf_dir).where(F.col("label").isNotNull() & F.col("score").isNotNull()).groupBy(F.year("date").alias("test_year")).agg(F.count(F.lit(1)).alias("n_test"))
    before = F.coalesce(F.sum("n_test").over(Window.orderBy("test_year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a year
    return y.withColumn("n_train", before).where((F.col("n_train") >= 1000) & (F.col("n_test") >= 100)).select("test_year", "n_train", "n_test")


@query(f"{R}, {LABELS}, a AS (SELECT year(date) AS year, {ranks('score').replace('PARTITION BY date', 'PARTITION BY year(date)')} AS k, label FROM lab WHERE label IS NOT NULL AND score IS NOT NULL), s AS (SELECT year, sum(k) FILTER (label = 1) AS r, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM a GROUP BY 1), z AS (SELECT year::INT AS year, (r - p * (p + 1) / 2) / (p * q) AS auc, p + q AS n FROM s) SELECT year, {g('auc')}, n FROM z")
def regime_auc(spark, sf_dir):
    return out(S.auc(labelled(spark, sf_dir).withColumn("year", F.year("date")), "score", "label", ("year",)), "year", "auc", "n")


SCHEDULE = "sched AS (SELECT rb, coalesce(lead(rb) OVER (ORDER BY rb), max(rb) OVER ()) AS next FROM (SELECT max(date) AS rb FROM r GROUP BY date_trunc('{unit}', date)))"
WEIGHTS = """wt AS MATERIALIZED (SELECT symbol, rb, next, w FROM (SELECT *, CASE WHEN lo <= ns THEN -1.0 / ns WHEN hi <= nl THEN 1.0 / nl END AS w FROM (SELECT *, greatest(1, floor(k * 0.2)) AS nl, greatest(1, floor(k * 0.2)) AS ns FROM (
  SELECT r.symbol, rb, next, count(*) OVER (PARTITION BY rb) AS k, row_number() OVER (PARTITION BY rb ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY rb ORDER BY score, symbol DESC) AS lo FROM r JOIN sched ON rb = date WHERE score IS NOT NULL)) WHERE k >= nl + ns + 1) WHERE w IS NOT NULL)"""
BACKTEST = f"""dly AS (SELECT r.symbol, r.date, coalesce(ret, 0) AS x, coalesce(wt.w, 0) AS w FROM r LEFT JOIN sched s ON r.date > s.rb AND r.date <= s.next LEFT JOIN wt ON wt.rb = s.rb AND wt.symbol = r.symbol),
dw AS (SELECT *, abs(w - lag(w) OVER {H}) AS dw FROM dly), c0 AS (SELECT date, sum(w * x) AS gross, avg(x) AS bench, sum(dw) AS turnover FROM dw GROUP BY date),
c1 AS (SELECT c0.*, CASE WHEN lag(s.rb) OVER (ORDER BY date) IS NOT NULL THEN turnover / 2 * 0.00102 ELSE 0 END AS cost FROM c0 LEFT JOIN sched s ON s.rb = c0.date),
bt AS MATERIALIZED (SELECT *, gross - cost AS net, product(1 + gross - cost) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity, product(1 + bench) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS benchmark FROM c1)"""


def metric_sql(source: str, keys: str = "", trades: str = "NULL") -> str:
    by, part = (f"GROUP BY {keys}", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""SELECT {keys + ',' if keys else ''} arg_max(equity, date) - 1 AS total_return, pow(arg_max(equity, date), 1 / ((max(date) - min(date)) / 365.25)) - 1 AS ann_return,
  CASE WHEN stddev_samp(net) > 1e-12 THEN sqrt(252.0) * (avg(net) - 0.02 / 252) / stddev_samp(net) ELSE 0 END AS sharpe, min(dd) AS max_drawdown, {trades} AS n_trades
  FROM (SELECT *, equity / max(equity) OVER ({part} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {source}) {by}"""


def backtested(spark, sf_dir, every="monthly"):
    p = base_once(spark, sf_dir)
    schedule = P.rebalance_dates(p, every)
    return P.section_backtest(p, P.section_weights(p, schedule, 0.2, 0.2), schedule)


for _every, _unit in (("monthly", "month"), ("weekly", "week"), ("quarterly", "quarter")):

    def _dates(spark, sf_dir, every=_every):
        return out(P.rebalance_dates(base(spark, sf_dir), every), "rb", "next")

    def _curve(spark, sf_dir, every=_every):
        return out(backtested(spark, sf_dir, every), "date", "gross", "cost", "net", "bench", "equity", "benchmark", "turnover")

    QUERIES[f"rebalance_dates_{_every}"], QUERIES[f"xs_backtest_{_every}"] = _dates, _curve
    SQL[f"rebalance_dates_{_every}"] = f"{R}, {SCHEDULE.format(unit=_unit)} SELECT rb::VARCHAR AS rb, next::VARCHAR AS next FROM sched"
    SQL[f"xs_backtest_{_every}"] = f"{R}, {SCHEDULE.format(unit=_unit)}, {WEIGHTS}, {BACKTEST} SELECT {D}, {', '.join(map(g, ('gross', 'cost', 'net', 'bench', 'equity', 'benchmark', 'turnover')))} FROM bt"


@query(f"{R}, {SCHEDULE.format(unit='month')}, {WEIGHTS} SELECT symbol, rb::VARCHAR AS rb, next::VARCHAR AS next, {g('w')} FROM wt")
def xs_weights(spark, sf_dir):
    p = base(spark, sf_dir)
    return out(P.section_weights(p, P.rebalance_dates(p), 0.2, 0.2), "symbol", "rb", "next", "w")


_M = ("total_return", "ann_return", "sharpe", "max_drawdown")


@query(f"{R}, {SCHEDULE.format(unit='month')}, {WEIGHTS}, {BACKTEST}, m AS ({metric_sql('bt')}), a AS (SELECT sqrt(252.0) * avg(net - bench) / stddev_samp(net - bench) AS information_ratio, avg(turnover) AS turnover FROM bt) SELECT {', '.join(map(g, (*_M, 'information_ratio', 'turnover')))} FROM m, a")
def xs_metrics(spark, sf_dir):
    c = backtested(spark, sf_dir)
    active = F.col("net") - F.col("bench")
    a = c.agg((F.sqrt(F.lit(252.0)) * F.avg(active) / F.stddev_samp(active)).alias("information_ratio"), F.avg("turnover").alias("turnover"))
    return out(P.metrics(c).crossJoin(F.broadcast(a)), *_M, "information_ratio", "turnover")


MA = f"""ma AS (SELECT symbol, date, close, CASE WHEN count(close) OVER {h(3)} = 4 THEN avg(close) OVER {h(3)} END AS m4, CASE WHEN count(close) OVER {h(7)} = 8 THEN avg(close) OVER {h(7)} END AS m8, CASE WHEN count(close) OVER {h(19)} = 20 THEN avg(close) OVER {h(19)} END AS m20 FROM bars),
sig AS (SELECT symbol, date, close, f AS fast, s AS slow, coalesce(CASE f WHEN 4 THEN m4 ELSE m8 END > CASE s WHEN 8 THEN m8 ELSE m20 END + 1e-9, false)::INT AS signal FROM ma, (VALUES (4, 8), (4, 20), (8, 20)) v(f, s)),
b0 AS (SELECT *, coalesce(lag(signal) OVER q, 0)::DOUBLE AS position, coalesce(close / lag(close) OVER q - 1, 0) AS ret FROM sig WINDOW q AS (PARTITION BY symbol, fast, slow ORDER BY date)),
b1 AS (SELECT *, position - lag(position) OVER q AS trade FROM b0 WINDOW q AS (PARTITION BY symbol, fast, slow ORDER BY date)),
b2 AS (SELECT *, CASE WHEN trade IS NOT NULL THEN position * ret - greatest(trade, 0) * 0.00026 - greatest(-trade, 0) * 0.00076 END AS net FROM b1),
sb AS MATERIALIZED (SELECT *, CASE WHEN net IS NOT NULL THEN product(1 + net) OVER (PARTITION BY symbol, fast, slow ORDER BY date ROWS UNBOUNDED PRECEDING) END AS equity, product(1 + ret) OVER (PARTITION BY symbol, fast, slow ORDER BY date ROWS UNBOUNDED PRECEDING) AS benchmark FROM b2)"""
PAIRS = [(4, 8), (4, 20), (8, 20)]
_KEYS = ("symbol", "fast", "slow")


def traded(spark, sf_dir, pairs=PAIRS):
    return P.signal_backtest(P.crossover(B.weekly(spark, sf_dir), pairs), _KEYS)


@query(f"WITH {B.SQL}, {MA} SELECT symbol, {D}, {', '.join(map(g, ('position', 'net', 'equity', 'benchmark')))} FROM sb WHERE fast = 4 AND slow = 20")
def signal_backtest(spark, sf_dir):
    return out(traded(spark, sf_dir, [(4, 20)]), "symbol", "date", "position", "net", "equity", "benchmark")


@query(f"WITH {B.SQL}, {MA}, m AS ({metric_sql('sb', 'symbol, fast, slow', 'sum(abs(trade))::BIGINT')}) SELECT symbol, fast, slow, {', '.join(map(g, _M))}, n_trades FROM m")
def ma_grid(spark, sf_dir):
    return out(P.metrics(traded(spark, sf_dir), _KEYS), *_KEYS, *_M, "n_trades")


@query(f"""WITH {B.SQL}, {MA}, m AS ({metric_sql('sb', 'symbol, fast, slow', 'NULL')}), k AS (SELECT symbol, fast, slow, sharpe, row_number() OVER (PARTITION BY symbol ORDER BY round_even(sharpe * 1048576, 0) DESC, fast, slow) AS i FROM m) SELECT symbol, fast, slow, {g('sharpe')} FROM k WHERE i = 1""")
def ma_best(spark, sf_dir):
    m = P.metrics(traded(spark, sf_dir), _KEYS)
    best = Window.partitionBy("symbol").orderBy(F.rint(F.col("sharpe") * 1048576).desc(), "fast", "slow")
    return out(m.withColumn("_i", F.row_number().over(best)).where(F.col("_i") == 1), *_KEYS, "sharpe")


@query(f"""WITH {B.SQL}, {MA}, s AS (SELECT symbol, fast, slow, CASE WHEN date < '1998-07-01' THEN 'train' ELSE 'test' END AS part, net FROM sb), v AS (SELECT symbol, fast, slow, part, CASE WHEN stddev_samp(net) > 1e-12 THEN sqrt(252.0) * avg(net) / stddev_samp(net) ELSE 0 END AS s FROM s GROUP BY ALL),
o AS (SELECT symbol, fast, slow, max(s) FILTER (part = 'train') AS train, max(s) FILTER (part = 'test') AS test FROM v GROUP BY ALL) SELECT symbol, fast, slow, {g('train')}, {g('test')}, {g("CASE WHEN train > 0 THEN test / train ELSE -999.0 END", 'ratio')} FROM o""")
def overfit_ratio(spark, sf_dir):
    s = traded(spark, sf_dir).withColumn("train_", F.col("date") < F.lit("1998-07-01").cast("date"))
    sharpe = lambda c: F.when(F.stddev_samp(c) > 1e-12, F.sqrt(F.lit(252.0)) * F.avg(c) / F.stddev_samp(c)).otherwise(0.0)
    o = s.groupBy(*_KEYS).agg(sharpe(F.when(F.col("train_"), F.col("net"))).alias("train"), sharpe(F.when(~F.col("train_"), F.col("net"))).alias("test"))
    return out(o.withColumn("ratio", F.when(F.col("train") > 0, F.col("test") / F.col("train")).otherwise(-999.0)), *_KEYS, "train", "test", "ratio")


OVERLAP = f"""t0 AS (SELECT r.symbol, r.date, close, score, n, coalesce(score >= e[2] - 1e-12, false) AS up, coalesce(score <= e[1] + 1e-12, false) AS down FROM r JOIN (SELECT date, quantile_cont(score, [0.2, 0.8]) AS e, count(score) AS n FROM r GROUP BY date) q USING (date)),
t1 AS (SELECT *, CASE WHEN n < 15 THEN 0.0 WHEN down THEN -1.0 / sum(down::INT) OVER (PARTITION BY date) WHEN up THEN 1.0 / sum(up::INT) OVER (PARTITION BY date) ELSE 0.0 END AS target, lead(close, 2) OVER {H} / lead(close, 1) OVER {H} - 1 AS x FROM t0),
t2 AS (SELECT *, avg(target) OVER {h(4)} AS held FROM t1), t3 AS (SELECT *, lag(held) OVER {H} AS b4 FROM t2),
t4 AS (SELECT date, sum(b4 * x) AS gross, coalesce(sum(abs(held - b4)), 0) AS turnover FROM t3 GROUP BY date), t5 AS (SELECT date, gross - turnover * 0.003 / 2 AS port_ret, turnover, row_number() OVER (ORDER BY date) AS i FROM t4),
op AS MATERIALIZED (SELECT date, port_ret, turnover, product(1 + port_ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM t5 WHERE i > 5 AND port_ret IS NOT NULL)"""
PERF = "pow(1 + avg(port_ret), 252.0) - 1 AS annual, avg(port_ret) / stddev_samp(port_ret) * sqrt(252.0) AS sharpe, count(*) AS n"


@query(f"{R}, {OVERLAP} SELECT {D}, {', '.join(map(g, ('port_ret', 'turnover', 'cum')))} FROM op")
def overlap_portfolio(spark, sf_dir):
    return out(P.overlapping(base(spark, sf_dir)), "date", "port_ret", "turnover", "cum")


@query(f"{R}, {OVERLAP}, m AS (SELECT {PERF}, min(dd) AS mdd FROM (SELECT *, cum / max(cum) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM op)) SELECT {g('annual')}, {g('sharpe')}, {g('mdd')}, n FROM m")
def perf_metrics(spark, sf_dir):
    return out(P.performance(P.overlapping(base(spark, sf_dir))), "annual", "sharpe", "mdd", "n")


@query(f"{R}, {OVERLAP}, m AS (SELECT date_trunc('month', date)::DATE AS month, product(1 + port_ret) - 1 AS ret FROM op GROUP BY 1) SELECT month::VARCHAR AS month, {g('ret')} FROM m")
def monthly_returns(spark, sf_dir):
    return out(P.monthly(P.overlapping(base(spark, sf_dir))), "month", "ret")


@query(f"""{R}, v AS (SELECT symbol, date, lead(close, 2) OVER {H} / lead(close, 1) OVER {H} - 1 AS x, score FROM r), k AS (SELECT * FROM v WHERE x IS NOT NULL AND score IS NOT NULL),
q AS (SELECT date, quantile_cont(score, [0.2, 0.8]) AS e, count(*) AS n FROM k GROUP BY date), s AS (SELECT date, CASE WHEN any_value(n) >= 15 THEN avg(x) FILTER (score >= e[2] - 1e-12) - avg(x) FILTER (score <= e[1] + 1e-12) END AS s FROM k JOIN q USING (date) GROUP BY date),
a AS (SELECT d.date, s FROM (SELECT DISTINCT date FROM r) d LEFT JOIN s USING (date)), o AS (SELECT date, CASE WHEN count(s) OVER w = 5 THEN avg(s) OVER w - 2 * 0.003 / 5 END AS port_ret FROM a WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT {D}, {g('port_ret')} FROM o WHERE port_ret IS NOT NULL""")
def naive_portfolio(spark, sf_dir):
    return out(P.naive_overlapping(base(spark, sf_dir)), "date", "port_ret")


CAPM = "cx AS MATERIALIZED (SELECT symbol, date, ret - 0.03 / 252 AS y, avg(ret) OVER (PARTITION BY date) - 0.03 / 252 AS x FROM r WHERE ret IS NOT NULL)"


def excess(spark, sf_dir):
    p = base(spark, sf_dir).where(F.col("ret").isNotNull())
    return p.select("symbol", "date", (F.col("ret") - 0.03 / 252).alias("y"), (F.avg("ret").over(E.day()) - 0.03 / 252).alias("x"))


@query(f"""{R}, {CAPM}, s AS (SELECT symbol, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, count(*) AS n, var_pop(x) AS vx, avg(x) AS mx, var_pop(y) AS vy, covar_pop(y, x) AS c FROM cx GROUP BY symbol),
t AS (SELECT *, n * (vy - beta * c) / (n - 2) AS s2, beta * c / vy AS r2 FROM s), u AS (SELECT symbol, alpha, beta, alpha / sqrt(s2 * (1.0 / n + mx * mx / (n * vx))) AS t_alpha, beta / sqrt(s2 / (n * vx)) AS t_beta, r2, n FROM t) SELECT symbol, {', '.join(map(g, ('alpha', 'beta', 't_alpha', 't_beta', 'r2')))}, n FROM u""")
def capm(spark, sf_dir):
    return out(S.capm(excess(spark, sf_dir), ("symbol",)), "symbol", "alpha", "beta", "t_alpha", "t_beta", "r2", "n")


@query(f"{R}, {CAPM}, s AS (SELECT symbol, covar_samp(y, x) / var_pop(x) AS beta, avg(y) AS my, avg(x) AS mx, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(y, x) AS c, count(*) AS n FROM cx GROUP BY symbol), u AS (SELECT symbol, beta, my - beta * mx AS alpha, 1 - (vy - 2 * beta * c + beta * beta * vx) / vy AS r2, n FROM s) SELECT symbol, {', '.join(map(g, ('beta', 'alpha', 'r2')))}, n FROM u")
def capm_mixed(spark, sf_dir):
    return out(S.capm_mixed(excess(spark, sf_dir), ("symbol",)), "symbol", "beta", "alpha", "r2", "n")


_PREV = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)"


@query(f"{R}, {CAPM}, u AS (SELECT symbol, date, CASE WHEN count(y) OVER {_PREV} = 52 THEN covar_pop(y, x) OVER {_PREV} / var_pop(x) OVER {_PREV} END AS beta, avg(y) OVER {_PREV} AS my, avg(x) OVER {_PREV} AS mx FROM cx), v AS (SELECT symbol, date, beta, my - beta * mx AS alpha FROM u) SELECT symbol, {D}, {g('alpha')}, {g('beta')} FROM v")
def rolling_capm(spark, sf_dir):
    return out(S.rolling_capm(excess(spark, sf_dir), 52, ("symbol",)), "symbol", "date", "alpha", "beta")


@query(f"""{R}, {OVERLAP}, u AS (SELECT date, port_ret, port_ret - avg(port_ret) OVER () AS u FROM op), l AS (SELECT *, {', '.join(f'lag(u, {k}) OVER (ORDER BY date) AS l{k}' for k in range(1, 6))} FROM u),
s AS (SELECT avg(port_ret) AS m, stddev_samp(port_ret) AS sd, count(*) AS n, (sum(u * u) + {' + '.join(f'2 * (1 - {k} / 6.0) * sum(u * l{k})' for k in range(1, 6))}) / count(*) AS v FROM l), z AS (SELECT m / sd * sqrt(252.0) AS sharpe, m / sqrt(v) * sqrt(252.0) AS nw_sharpe, n FROM s) SELECT {g('sharpe')}, {g('nw_sharpe')}, n FROM z""")
def newey_west_sharpe(spark, sf_dir):
    return out(S.newey_west(P.overlapping(base(spark, sf_dir)), "port_ret", 5), "sharpe", "nw_sharpe", "n")


@query(f"{R}, k AS (SELECT symbol, date, ret, lag(ret) OVER {H} AS l FROM r WHERE ret IS NOT NULL), q AS (SELECT symbol, quantile_cont(ret, 0.05) AS var FROM k GROUP BY 1), s AS (SELECT symbol, var, avg(ret) FILTER (ret <= var + 1e-15) AS cvar, corr(ret, l) AS autocorr FROM k JOIN q USING (symbol) GROUP BY ALL) SELECT symbol, {g('var')}, {g('cvar')}, {g('autocorr')} FROM s")
def var_cvar(spark, sf_dir):
    return out(S.risk(base(spark, sf_dir).where(F.col("ret").isNotNull()), "ret", ("symbol",)), "symbol", "var", "cvar", "autocorr")


LCG = "(((({x}) * 48271 + 69621 + 11) % 2147483647) * 16807 + 7) % 2147483647"
BOOT = f"""ser AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, port_ret AS r FROM op), nn AS (SELECT count(*) AS n FROM ser),
dr AS (SELECT rep, k, {LCG.format(x='rep * 7919 + k * 104729 + 42')} % (n - 19) AS st, n FROM nn, range(10000) a(rep), LATERAL (SELECT unnest(range((n + 19) // 20)) AS k)),
bs AS (SELECT rep, CASE WHEN stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(252.0) ELSE 0 END AS sharpe FROM dr, range(20) b(j) JOIN ser ON ser.i = st + j WHERE k * 20 + j < n GROUP BY rep)"""


@query(f"{R}, {OVERLAP}, {BOOT} SELECT rep, {g('sharpe')} FROM bs")
def block_bootstrap(spark, sf_dir):
    return out(S.block_bootstrap(P.overlapping(base(spark, sf_dir)), "port_ret"), "rep", "sharpe")


@query(f"{R}, {OVERLAP}, {BOOT}, o AS (SELECT avg(port_ret) / stddev_samp(port_ret) * sqrt(252.0) AS s FROM op), p AS (SELECT any_value(o.s) AS observed, avg(CASE WHEN o.s > 0 THEN (sharpe <= 0)::INT ELSE (sharpe >= 0)::INT END) AS p_value, 100.0 * (sum((sharpe < o.s)::INT) + sum((sharpe <= o.s)::INT) + (sum((sharpe <= o.s)::INT) > sum((sharpe < o.s)::INT))::INT) / (2 * count(*)) AS percentile FROM bs, o) SELECT {g('observed')}, {g('p_value')}, {g('percentile')} FROM p")
def bootstrap_p_value(spark, sf_dir):
    r = P.overlapping(base(spark, sf_dir))
    o = P.performance(r).select(F.col("sharpe").alias("observed"))
    b = S.block_bootstrap(r, "port_ret").crossJoin(F.broadcast(o))
    p = b.groupBy("observed").agg(F.avg(F.when(F.col("observed") > 0, F.col("sharpe") <= 0).otherwise(F.col("sharpe") >= 0).cast("double")).alias("p_value"))
    return out(p.join(S.percentile_of(b, "sharpe", "observed", ("observed",)), "observed"), "observed", "p_value", "percentile")


IID = f"""ser AS (SELECT symbol, ret AS r, row_number() OVER {H} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL),
dr AS (SELECT symbol, rep, {LCG.format(x='rep * 7919 + i * 104729 + symbol * 15485863 + 7')} % n AS i FROM ser, range(200) a(rep)), bs AS (SELECT symbol, rep, avg(r) AS m FROM dr JOIN ser USING (symbol, i) GROUP BY ALL)"""


@query(f"{R}, {IID}, p AS (SELECT symbol, avg((m <= 0)::INT) AS p_value FROM bs GROUP BY 1) SELECT symbol, {g('p_value')}, p_value < 0.05 / count(*) OVER () AS bonferroni FROM p")
def bonferroni(spark, sf_dir):
    b = S.iid_bootstrap(base(spark, sf_dir), "ret", 200)
    p = b.groupBy("symbol").agg(F.avg((F.col("m") <= 0).cast("double")).alias("p_value"))
    tests = p.agg(F.count(F.lit(1)).alias("tests"))
    return out(p.crossJoin(F.broadcast(tests)).withColumn("bonferroni", F.col("p_value") < 0.05 / F.col("tests")), "symbol", "p_value", "bonferroni")


@query(f"WITH {B.SQL} SELECT symbol, count(*) AS n_rows, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date FROM bars GROUP BY 1")
def cache_summary(spark, sf_dir):
    return out(B.summary(B.weekly(spark, sf_dir)), "symbol", "n_rows", "first_date", "last_date")


@query(f"WITH {B.SQL}, fresh AS (SELECT * REPLACE (close * 2 AS close) FROM bars WHERE date >= '2000-06-01' AND symbol % 2 = 0), o AS (SELECT symbol, date, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.symbol = b.symbol AND f.date = b.date) UNION ALL SELECT symbol, date, close FROM fresh) SELECT symbol, {D}, {g('close')} FROM o")
def upsert_bars(spark, sf_dir):
    old = B.weekly(spark, sf_dir)
    new = old.where((F.col("date") >= F.lit("2000-06-01").cast("date")) & (F.col("symbol") % 2 == 0)).withColumn("close", F.col("close") * 2)
    return out(B.merged(old, new), "symbol", "date", "close")


@query(f"WITH {B.SQL} SELECT symbol, {D}, {g('close')} FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 290)")
def long_enough(spark, sf_dir):
    return out(B.long_enough(B.weekly(spark, sf_dir), 290), "symbol", "date", "close")


@query("SELECT s_suppkey, CASE left(c, 1) WHEN '6' THEN 'sh.' ELSE 'sz.' END || c AS code FROM (SELECT s_suppkey, lpad((s_suppkey * 7919 % 1000000)::VARCHAR, 6, '0') AS c FROM supplier)")
def exchange_codes(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select("s_suppkey", B.exchange_code(F.lpad((F.col("s_suppkey") * 7919 % 1000000).cast("string"), 6, "0")).alias("code"))


@query(f"""WITH {B.SQL}, d AS (SELECT symbol, date, close, lag(close) OVER {H} AS b FROM bars), x AS (SELECT symbol, max(date) AS delist_date FROM bars WHERE symbol % 10 = 0 AND date <= '1999-12-31' GROUP BY 1),
o AS (SELECT d.symbol, d.date, CASE WHEN d.date > delist_date THEN NULL WHEN d.date = delist_date AND b IS NOT NULL THEN close * 0.9 / b - 1 ELSE close / b - 1 END AS ret FROM d LEFT JOIN x USING (symbol)) SELECT symbol, {D}, {g('ret')} FROM o""")
def delisting_returns(spark, sf_dir):
    bars = B.weekly(spark, sf_dir)
    gone = bars.where((F.col("symbol") % 10 == 0) & (F.col("date") <= F.lit("1999-12-31").cast("date"))).groupBy("symbol").agg(F.max("date").alias("delist_date")).withColumn("liquidation_price", F.lit(None).cast("double"))
    return out(P.delisted(E.padded_returns(bars), gone), "symbol", "date", "ret")


def overlap_sql(days: int) -> str:
    return OVERLAP.replace(h(4), h(days - 1)).replace("WHERE i > 5", f"WHERE i > {days}")


_GRID = (5, 8, 10, 15, 20)
_HELD = ", ".join(sum(([f"o{d} AS (SELECT {d} AS hold_days, port_ret, cum / max(cum) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM op_{d})"] for d in _GRID), []))


def _renamed(sql: str, d: int) -> str:
    for t in ("t0", "t1", "t2", "t3", "t4", "t5", "op"):
        sql = sql.replace(f"{t} AS ", f"{t}_{d} AS ").replace(f"FROM {t} ", f"FROM {t}_{d} ").replace(f"FROM {t})", f"FROM {t}_{d})")
    return sql


@query(f"{R}, {', '.join(_renamed(overlap_sql(d), d) for d in _GRID)}, {_HELD}, m AS ({' UNION ALL '.join(f'SELECT hold_days, {PERF}, min(dd) AS mdd FROM o{d} GROUP BY 1' for d in _GRID)}) SELECT hold_days, {g('annual')}, {g('sharpe')}, {g('mdd')}, n FROM m")
def hold_grid(spark, sf_dir):
    p = base_once(spark, sf_dir)
    runs = None
    for d in _GRID:
        one = P.overlapping(p, d).select(F.lit(d).alias("hold_days"), "date", "port_ret")
        runs = one if runs is None else runs.union(one)
    return out(P.performance(runs, keys=("hold_days",)), "hold_days", "annual", "sharpe", "mdd", "n")


@query(f"{R}, {UNIVERSE}, v AS (SELECT date, avg(vol) FILTER (member) AS mv FROM (SELECT date, member, CASE WHEN count(ret) OVER {h(19)} = 20 THEN stddev_samp(ret) OVER {h(19)} END AS vol FROM u) GROUP BY date), sc AS (SELECT date, CASE WHEN mv > (SELECT quantile_cont(mv, 0.5) FROM v) THEN 0.5 ELSE 1.0 END AS scale FROM v), {OVERLAP.replace('t3 AS (SELECT *, lag(held)', 't2s AS (SELECT t2.* EXCLUDE held, held * coalesce(scale, 1) AS held FROM t2 LEFT JOIN sc USING (date)), t3 AS (SELECT *, lag(held)').replace('AS b4 FROM t2)', 'AS b4 FROM t2s)')} SELECT {D}, {', '.join(map(g, ('port_ret', 'turnover', 'cum')))} FROM op")
def scaled_portfolio(spark, sf_dir):
    m = members(spark, sf_dir)
    vol = S.market_features(m, 20, 52).select("date", F.col("market_vol_20d").alias("mv"))
    middle = vol.agg(F.percentile("mv", 0.5).alias("middle"))
    scale = vol.crossJoin(F.broadcast(middle)).select("date", F.when(F.col("mv") > F.col("middle"), 0.5).otherwise(1.0).alias("scale"))
    return out(P.overlapping(m, scale=scale), "date", "port_ret", "turnover", "cum")


def _share_sql(share: float, name: str) -> str:
    sql = f"{WEIGHTS.replace('0.2', str(share))}, {BACKTEST}".replace("sched AS", "_")
    for t in ("wt", "dly", "dw", "c0", "c1", "bt"):
        for a, b in ((f"{t} AS MATERIALIZED", f"{t}_{name} AS MATERIALIZED"), (f"{t} AS (", f"{t}_{name} AS ("), (f"FROM {t})", f"FROM {t}_{name})"), (f"FROM {t} ", f"FROM {t}_{name} "), (f"JOIN {t} ON", f"JOIN {t}_{name} {t} ON")):
            sql = sql.replace(a, b)
    return sql.replace(f"FROM c0_{name} LEFT JOIN", f"FROM c0_{name} c0 LEFT JOIN")


_SHARES = {"a": 0.1, "b": 0.2, "c": 0.3}


@query(f"{R}, {SCHEDULE.format(unit='month')}, {', '.join(_share_sql(v, k) for k, v in _SHARES.items())}, m AS ({' UNION ALL '.join(f'SELECT {v} AS share, x.* FROM ({metric_sql(f"bt_{k}")}) x' for k, v in _SHARES.items())}) SELECT {', '.join(map(g, ('share', *_M)))} FROM m")
def top_share_scan(spark, sf_dir):
    p = base_once(spark, sf_dir)
    schedule = P.rebalance_dates(p)
    runs = None
    for v in _SHARES.values():
        one = P.section_backtest(p, P.section_weights(p, schedule, v, v), schedule).withColumn("share", F.lit(v))
        runs = one if runs is None else runs.union(one)
    return out(P.metrics(runs, ("share",)), "share", *_M)


@query(f"""WITH {B.SQL}, {MA}, y AS (SELECT DISTINCT year(date) AS test_year FROM bars), tr AS (SELECT symbol, test_year, fast, slow, CASE WHEN stddev_samp(net) > 1e-12 THEN sqrt(252.0) * (avg(net) - 0.02 / 252) / stddev_samp(net) ELSE 0 END AS s FROM sb JOIN y ON year(date) >= test_year - 3 AND year(date) < test_year GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol, test_year ORDER BY round_even(s * 1048576, 0) DESC, fast, slow) AS i FROM tr), o AS (SELECT b.symbol, b.test_year::INT AS test_year, b.fast, b.slow, product(1 + coalesce(net, 0)) - 1 AS test_return FROM b JOIN sb ON sb.symbol = b.symbol AND sb.fast = b.fast AND sb.slow = b.slow AND year(sb.date) = test_year WHERE i = 1 GROUP BY ALL) SELECT symbol, test_year, fast, slow, {g('test_return')} FROM o""")
def walk_forward_ma(spark, sf_dir):
    t = traded(spark, sf_dir).withColumn("year", F.year("date"))
    spread = t.withColumn("test_year", F.explode(F.sequence(F.col("year") + 1, F.col("year") + 3))).join(F.broadcast(t.select(F.col("year").alias("test_year")).distinct()), "test_year")
    train = spread.groupBy("symbol", "test_year", "fast", "slow").agg((F.when(F.stddev_samp("net") > 1e-12, F.sqrt(F.lit(252.0)) * (F.avg("net") - 0.02 / 252) / F.stddev_samp("net")).otherwise(0.0)).alias("s"))
    best = Window.partitionBy("symbol", "test_year").orderBy(F.rint(F.col("s") * 1048576).desc(), "fast", "slow")
    chosen = train.withColumn("i", F.row_number().over(best)).where(F.col("i") == 1).select("symbol", F.col("test_year").alias("year"), "fast", "slow")
    done = t.join(chosen, ["symbol", "year", "fast", "slow"]).groupBy("symbol", F.col("year").alias("test_year"), "fast", "slow").agg((F.product(1 + F.coalesce("net", F.lit(0.0))) - 1).alias("test_return"))
    return out(done, "symbol", "test_year", "fast", "slow", "test_return")


@query(f"""{R}, k AS (SELECT * FROM n WHERE score IS NOT NULL AND score2 IS NOT NULL AND fwd IS NOT NULL), d AS (SELECT date, var_pop(score) AS v1, var_pop(score2) AS v2, covar_pop(score, score2) AS c12, covar_pop(score, fwd) AS c1, covar_pop(score2, fwd) AS c2 FROM k GROUP BY date HAVING count(*) >= 9),
o AS (SELECT date, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b_score, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b_score2 FROM d WHERE v1 * v2 - c12 * c12 > 1e-12) SELECT {D}, {g('b_score')}, {g('b_score2')} FROM o""")
def fama_macbeth_multi(spark, sf_dir):
    return out(MOD.daily_ols(E.next_returns(base(spark, sf_dir)), "fwd", ["score", "score2"]), "date", "b_score", "b_score2")


_TRAIN_LONG = " UNION ALL ".join(f"SELECT fold, '{k}' AS s, date, z{i} AS score, fwd FROM rows_ WHERE part = 'train'" for i, k in enumerate(SCORES))
_SECTION_RANK = "rank() OVER (PARTITION BY fold, s, date ORDER BY {0}) + (count(*) OVER (PARTITION BY fold, s, date, {0}) - 1) / 2.0"
_PREDICTED = " + ".join(f"coalesce(z{i}, 0) * coalesce(max(w) FILTER (s = '{k}'), 0)" for i, k in enumerate(SCORES))


@query(f"""{R}, {LABELS}, days AS (SELECT DISTINCT date FROM lab WHERE label IS NOT NULL), {fold_sql('days', 'date')}, zz AS (SELECT symbol, date, {_Z} FROM r),
rows_ AS MATERIALIZED (SELECT p_.fold, p_.part, lab.symbol, lab.date, lab.label, lab.fwd, z0, z1, z2, z3 FROM p_ JOIN lab USING (date) JOIN zz USING (symbol, date) WHERE label IS NOT NULL AND part IS NOT NULL),
tl AS ({_TRAIN_LONG}), tr AS (SELECT fold, s, date, {_SECTION_RANK.format('score')} AS a, {_SECTION_RANK.format('fwd')} AS b FROM tl WHERE score IS NOT NULL AND fwd IS NOT NULL),
ti AS (SELECT fold, s, date, corr(a, b) AS ic FROM tr GROUP BY ALL HAVING count(*) >= 10 AND min(a) < max(a) AND min(b) < max(b)), ir AS (SELECT fold, s, avg(ic) / nullif(stddev_pop(ic), 0) AS ir FROM ti GROUP BY ALL),
w AS (SELECT fold, s, ir / sum(abs(ir)) OVER (PARTITION BY fold) AS w FROM ir), o AS (SELECT fold, symbol, date, label, {_PREDICTED} AS pred FROM rows_ JOIN w USING (fold) WHERE part = 'validation' GROUP BY fold, symbol, date, label, z0, z1, z2, z3)
SELECT fold, symbol, {D}, {g('pred')}, label FROM o""")
def linear_baseline(spark, sf_dir):
    y = U.labels(E.horizon_returns(base(spark, sf_dir)))
    return out(MOD.out_of_fold(y, list(SCORES)), "fold", "symbol", "date", "pred", "label")


def moved_sql(source: str, group: str, item: str, values: list[str], seed: str) -> str:
    """The source's rows with their place in the group and the place that each value moves to."""
    at = [f"row_number() OVER (PARTITION BY {group} ORDER BY {LCG.format(x=f'{seed} + {k}')}, {item}) AS o_{v}" for k, v in enumerate(values)]
    return f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {item}) AS i, {', '.join(at)} FROM {source}"


def importance_sql(keys: str = "") -> str:
    """AUC of vv(keys, feature, label, p) by feature; ui has the columns of the operator."""
    by = f"{keys}, feature" if keys else "feature"
    same = f"b.{keys} = a.{keys} AND " if keys else ""
    return f"""ar AS (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS k FROM (SELECT {by}, label, round_even(p * 1073741824, 0) / 1073741824 AS p FROM vv) WHERE p IS NOT NULL),
as_ AS (SELECT {by}, sum(k) FILTER (label = 1) AS r, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM ar GROUP BY ALL), au AS (SELECT {by}, (r - p * (p + 1) / 2) / (p * q) AS auc, p + q AS n FROM as_),
ui AS (SELECT a.*, b.auc AS base FROM au a JOIN au b ON {same}b.feature = '' WHERE a.feature <> '')"""


def known_sql(more: str = "") -> str:
    kept_ = " AND ".join(f"r.{k} IS NOT NULL" for k in SCORES)
    return f"SELECT l.symbol, l.date, l.label, {', '.join(f'r.{k}' for k in SCORES)} FROM lab l JOIN r ON r.symbol = l.symbol AND r.date = l.date WHERE l.label IS NOT NULL AND {kept_} {more}"


EPOCH_DAY = "(date::DATE - DATE '1970-01-01')"
_ROW_SEED = f"symbol * 7919 + {EPOCH_DAY} * 104729 + 11"
_SUM = "z0 + z1 + z2 + z3"
_MOVED = " UNION ALL ".join([f"SELECT '' AS feature, label, {_SUM} AS p FROM z"] + [f"SELECT '{k}', z.label, {' + '.join(f'{"m" if j == i else "z"}.z{j}' for j in range(4))} FROM z JOIN z m ON m.date = z.date AND m.o_z{i} = z.i" for i, k in enumerate(SCORES)])


@query(f"""{R}, {LABELS}, k AS ({known_sql()}), z_ AS (SELECT symbol, date, label, {_Z} FROM k), z AS MATERIALIZED ({moved_sql('z_', 'date', 'symbol', [f"z{i}" for i in range(4)], _ROW_SEED)}),
vv AS ({_MOVED}), {importance_sql()} SELECT feature AS score, {g('base', 'auc')}, {g('auc', 'auc_permuted')}, {g('(base - auc)', '"drop"')} FROM ui""")
def permutation_importance(spark, sf_dir):
    y = U.labels(E.horizon_returns(base(spark, sf_dir)))
    return out(MOD.permutation_importance(y, list(SCORES)), "score", "auc", "auc_permuted", "drop")


@query(f"""{R}, {', '.join(bin_cte(k, f'bins_{k}') for k in SCORES)}, l AS ({' UNION ALL '.join(f"SELECT '{v}' AS factor, date, avg(fwd) FILTER (bin = 4) - avg(fwd) FILTER (bin = 0) AS ls FROM bins_{k} GROUP BY date" for k, v in SCORES.items())}),
s AS (SELECT factor, CASE WHEN avg(ls) < 0 THEN -1 ELSE 1 END AS sign FROM l GROUP BY 1), z AS (SELECT factor, date, ls * sign AS ls FROM l JOIN s USING (factor)), c AS (SELECT a.factor AS factor_a, b.factor AS factor_b, corr(a.ls, b.ls) AS corr FROM z a JOIN z b USING (date) WHERE a.ls IS NOT NULL AND b.ls IS NOT NULL GROUP BY ALL) SELECT factor_a, factor_b, {g('corr')} FROM c""")
def signal_similarity(spark, sf_dir):
    p = E.next_returns(base_once(spark, sf_dir))
    runs = None
    for k, v in SCORES.items():
        one = E.quantile_returns(p, k).select(F.lit(v).alias("factor"), "date", (F.col("q5") - F.col("q1")).alias("ls"))
        runs = one if runs is None else runs.union(one)
    runs = Written(runs).df  # a row a factor and date
    sign = runs.groupBy("factor").agg(F.when(F.avg("ls") < 0, -1).otherwise(1).alias("sign"))
    z = runs.join(F.broadcast(sign), "factor").select("factor", "date", (F.col("ls") * F.col("sign")).alias("ls")).where(F.col("ls").isNotNull())
    a, b = z.select(F.col("factor").alias("factor_a"), "date", F.col("ls").alias("x")), z.select(F.col("factor").alias("factor_b"), "date", F.col("ls").alias("y"))
    return out(a.join(b, "date").groupBy("factor_a", "factor_b").agg(E.correlation("x", "y").alias("corr")), "factor_a", "factor_b", "corr")


@query(f"""{R}, {UNIVERSE}, f AS (SELECT 'fixed' AS universe, date, avg(coalesce(ret, 0)) AS r FROM u WHERE symbol <= {TOP} GROUP BY date UNION ALL SELECT 'point_in_time', date, avg(coalesce(ret, 0)) FROM u WHERE member GROUP BY date),
m AS (SELECT universe, avg(r) AS mean, stddev_samp(r) AS deviation, count(*) AS n FROM f GROUP BY 1) SELECT universe, {g('mean')}, {g('deviation')}, n FROM m""")
def universe_bias(spark, sf_dir):
    m = members(spark, sf_dir).withColumn("r", F.coalesce("ret", F.lit(0.0)))
    fixed = m.where(F.col("symbol") <= TOP).groupBy("date").agg(F.avg("r").alias("r")).withColumn("universe", F.lit("fixed"))
    pit = m.where("member").groupBy("date").agg(F.avg("r").alias("r")).withColumn("universe", F.lit("point_in_time"))
    return out(fixed.union(pit).groupBy("universe").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("deviation"), F.count(F.lit(1)).alias("n")), "universe", "mean", "deviation", "n")


@query(f"""{R}, b AS (SELECT symbol, date, round(sum(close) OVER {h(3)} / 4, 6) AS x, fwd FROM n WHERE close IS NOT NULL), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, fwd) - 1) / 2.0 AS c FROM b), o AS (SELECT symbol, corr(a, c) AS ic, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 30) SELECT symbol, {g('ic')}, n FROM o""")
def series_ic(spark, sf_dir):
    b = E.next_returns(base(spark, sf_dir)).where(F.col("close").isNotNull())
    b = b.withColumn("x", F.round(F.sum("close").over(E.history().rowsBetween(-3, 0)) / 4, 6))

    def rank(c):
        w = Window.partitionBy("symbol").orderBy(c)
        return (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))) / 2.0

    k = b.select("symbol", rank("x").alias("a"), rank("fwd").alias("c"))
    return out(k.groupBy("symbol").agg(E.correlation("a", "c").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 30), "symbol", "ic", "n")


@query("SELECT DISTINCT l_partkey AS symbol FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 25")
def missing_symbols(spark, sf_dir):
    have = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 25").select(F.col("p_partkey").alias("symbol"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("symbol")).distinct().join(have, "symbol", "left_anti")


@query("""WITH u AS (SELECT s_suppkey AS symbol, s_name AS name, 1 AS source FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, 2 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey, upper(s_name), 3 FROM supplier)
SELECT symbol, name, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY source) AS k FROM u) WHERE k = 1""")
def first_source_wins(spark, sf_dir):
    s, c = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    u = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.lit(1).alias("source"))
    u = u.union(c.where("c_custkey % 3 = 0").select("c_custkey", "c_name", F.lit(2))).union(s.select("s_suppkey", F.upper("s_name"), F.lit(3)))
    first = Window.partitionBy("symbol").orderBy("source")
    return u.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


@query(f"WITH {B.SQL}, m AS (SELECT symbol, date, month(date) AS m, close FROM bars), t AS (SELECT symbol, m, avg(close) AS c FROM m GROUP BY ALL) SELECT symbol::BIGINT AS symbol, {', '.join(g(f'max(c) FILTER (m = {k})', f'm{k}') for k in (1, 6, 12))} FROM t GROUP BY symbol")
def monthly_pivot(spark, sf_dir):
    b = B.weekly(spark, sf_dir).withColumn("m", F.concat(F.lit("m"), F.month("date")))
    return out(b.groupBy("symbol").pivot("m", ["m1", "m6", "m12"]).agg(F.avg("close")), "symbol", "m1", "m6", "m12")


@query(f"WITH {B.SQL}, r AS (SELECT symbol, date, close, percent_rank() OVER (PARTITION BY date ORDER BY close) AS k FROM bars) SELECT least(floor(k * 10), 9)::BIGINT AS bin, count(*) AS n, {g('avg(close)', 'mean')} FROM r GROUP BY 1")
def equal_width_bins(spark, sf_dir):
    r = B.weekly(spark, sf_dir).withColumn("k", F.percent_rank().over(E.day().orderBy("close")))
    return out(r.groupBy(F.least(F.floor(F.col("k") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean")), "bin", "n", "mean")


@query(f"""WITH {B.SQL}, {MA}, t AS (SELECT symbol, net, trade FROM sb WHERE fast = 4 AND slow = 20), w AS (SELECT symbol, count(*) FILTER (trade <> 0) AS trades, coalesce(avg((net > 0)::INT) FILTER (trade <> 0), 0) AS win_rate FROM t GROUP BY 1) SELECT symbol, trades, {g('win_rate')} FROM w""")
def trade_win_rate(spark, sf_dir):
    t = traded(spark, sf_dir, [(4, 20)])
    on = F.col("trade") != 0
    return out(t.groupBy("symbol").agg(F.count(F.when(on, 1)).alias("trades"), F.coalesce(F.avg(F.when(on, (F.col("net") > 0).cast("double"))), F.lit(0.0)).alias("win_rate")), "symbol", "trades", "win_rate")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
