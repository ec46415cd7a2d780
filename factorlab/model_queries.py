"""Queries of the fitted models: boosted trees by purged folds, their importances, the final model, the network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphas import definitions
from .operators import boosting as T
from .operators import evaluation as E
from .operators import network as N
from .operators import portfolio as P
from .operators import screening as SC
from .operators import statistics as S
from .operators import universe as U
from .research_queries import g, out, placed_panel
from .sources import bars as B
from .sources.scratch import Written
from .study_queries import _LIBRARY, library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Factors that the models see beside the two market features: two of each kind of formula in the library.
FACTORS = tuple(f"alpha{n:03d}" for n in (1, 2, 5, 9, 14, 18, 32, 42, 55, 60, 76, 94, 120, 150, 167, 191))
MARKET = ("market_vol_20d", "market_turnover_20d")
FEATURES = [*FACTORS, *MARKET]
KEYS = ["symbol", "date"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def training_rows(panel: DataFrame, places: DataFrame, said: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """symbol, date, fwd, label, factors and market features of the members of each date, as a written table: labels are the
    upper and lower fifth of the members' returns over the next five bars."""
    mine = panel.where("ever").withColumn("member", F.col("place").isNotNull())  # others are no part of what follows
    market = S.market_features(mine, 20, 52)  # a row a date
    x = U.labels(mine.where("member").select(*KEYS, F.col("later").alias("fwd")))
    values = places.join(SC.member_values(said, list(factors)), ["date", "place"], "left").drop("place")
    return Written(x.join(values, KEYS).join(F.broadcast(market), "date")).df


def training_table(spark: SparkSession, sf_dir: str, factors: tuple[str, ...] = FACTORS) -> DataFrame:
    """training_rows() of the named factors. Factors are computed in blocks and told for members alone."""
    panel, places = placed_panel(spark, sf_dir)
    return training_rows(panel, places, SC.evaluated(panel, list(factors), judged=False), factors)


@query
def boosted_oof(spark, sf_dir):
    """Held-out probabilities of five purged folds, each from the trees of the fold that didn't see the row."""
    x = T.with_folds(training_table(spark, sf_dir))
    fit = T.boost(x, FEATURES, KEYS)
    held = x.where(F.col("valid").isNotNull() & F.col("label").isNotNull())
    p = T.scored(held, fit.model, FEATURES, KEYS, F.col("valid"))
    return out(held.select(*KEYS, F.col("valid").alias("fold"), "label").join(p, KEYS), "fold", *KEYS, "label", "p")


@query
def boosted_folds(spark, sf_dir):
    """Of each fold the rounds it keeps, its held-out rows and their AUC, with the pooled rank IC of all held-out rows."""
    x = T.with_folds(training_table(spark, sf_dir))
    fit = T.boost(x, FEATURES, KEYS)
    held = x.where(F.col("valid").isNotNull())
    p = held.select(*KEYS, F.col("valid").alias("fold"), "label", "fwd").join(T.scored(held, fit.model, FEATURES, KEYS, F.col("valid")), KEYS)
    by = S.auc(p, "p", "label", ("fold",))
    ic = E.rank_ic(p.select(F.struct("fold", "date").alias("date"), F.col("p").alias("score"), "fwd")).groupBy(F.col("date.fold").alias("fold")).agg(F.avg("ic").alias("ic_mean"))
    kept = spark.createDataFrame(list(fit.best.items()), "fold int, rounds int")
    return out(by.join(ic, "fold").join(F.broadcast(kept), "fold"), "fold", "rounds", "n", "auc", "ic_mean")


@query
def boosted_importance(spark, sf_dir):
    """Gain and number of splits by fold and feature."""
    fit = T.boost(T.with_folds(training_table(spark, sf_dir)), FEATURES, KEYS)
    return out(T.importance(fit.model, FEATURES), "fold", "feature", "gain", "splits")


@query
def final_model(spark, sf_dir):
    """Probabilities of all members by the model of all labelled rows, which is stored as a table, read again and joined."""
    x = training_table(spark, sf_dir)
    best = T.boost(T.with_folds(x), FEATURES, KEYS).best
    model = Written(T.final(x, FEATURES, KEYS, best))
    return out(T.scored(x, model.df, FEATURES, KEYS), *KEYS, "p")


@query
def network_oof(spark, sf_dir):
    """Held-out probabilities of the network of each purged fold."""
    x = T.with_folds(training_table(spark, sf_dir))
    model, scale = N.train(x, FEATURES, KEYS)
    held = x.where(F.col("valid").isNotNull() & F.col("label").isNotNull())
    p = N.scored(held, model, scale, FEATURES, KEYS, F.col("valid"))
    return out(held.select(*KEYS, F.col("valid").alias("fold"), "label").join(p, KEYS), "fold", *KEYS, "label", "p")


@query
def network_folds(spark, sf_dir):
    """Of each fold the epoch whose network is kept, the epochs run, and the held-out AUC of the kept and of the first."""
    model, _ = N.train(T.with_folds(training_table(spark, sf_dir)), FEATURES, KEYS)
    curve = model.where("name = 'auc'")
    return out(curve.select("fold", "epoch", F.size("value").alias("epochs"), F.array_max("value").alias("auc"), F.col("value")[0].alias("auc_first")), "fold", "epoch", "epochs", "auc", "auc_first")


# --- walk-forward with yearly choice from the whole library ---

_CALENDAR = "cal AS (SELECT date, year(lead(date) OVER (ORDER BY date))::INT AS known FROM (SELECT DISTINCT date FROM panel)), years AS (SELECT test_year FROM (SELECT DISTINCT year(date)::INT AS test_year FROM panel) WHERE test_year >= (SELECT min(year(date)) FROM panel) + 2)"


def yearly_sql() -> str:
    """The gates of each year, every one from the daily values themselves."""
    past = lambda source, value: f"(SELECT test_year, factor, {value} FROM {source} JOIN cal USING (date) JOIN years ON known < test_year GROUP BY ALL)"
    ratio = lambda x: f"avg({x}) / nullif(stddev_pop({x}), 0)"
    return f"""{_LIBRARY}, {_CALENDAR}, every AS (SELECT DISTINCT test_year, factor FROM (FROM ic SELECT factor UNION ALL FROM fm SELECT factor UNION ALL FROM cs SELECT factor), years)
SELECT test_year, factor, {g('ic_ir')}, {g('fm_t')}, {g('cs_effective_ratio')}, coalesce(abs(ic_ir) > 0.05 AND abs(fm_t) > 2 AND cs_effective_ratio > 0.5, false) AS passed
FROM every LEFT JOIN {past('ic', ratio('ic') + ' AS ic_ir')} USING (test_year, factor) LEFT JOIN {past('fm', ratio('slope') + ' * sqrt(count(*)) AS fm_t')} USING (test_year, factor) LEFT JOIN {past('cs', 'avg(f) AS cs_effective_ratio')} USING (test_year, factor)
WHERE coalesce(ic_ir, fm_t, cs_effective_ratio) IS NOT NULL"""


@query
def yearly_gates(spark, sf_dir):
    """The three gates of all factors for each year, from what is known before the year."""
    m = SC.yearly_gates(library(spark, sf_dir)).where("ic_ir IS NOT NULL OR fm_t IS NOT NULL OR cs_effective_ratio IS NOT NULL")
    return out(m, "test_year", "factor", "ic_ir", "fm_t", "cs_effective_ratio", "passed")


def pools(daily: DataFrame) -> DataFrame:
    """Each year's pool of factors from daily metrics, as a written table."""
    return Written(SC.yearly_pools(daily, SC.yearly_gates(daily))).df


@query
def yearly_pools(spark, sf_dir):
    return out(pools(library(spark, sf_dir)), "test_year", "place", "factor", "ic_ir", "n_passed")


#: Trees of a year's model, rows that it needs, days that a position is held.
ROUNDS, LEAST_ROWS, HOLD = 79, 1000, 10


@query
def walk_forward_library(spark, sf_dir):
    """For each year: factors chosen from the whole library by what is known before it, boosted trees on these and the market
    features, fitted to labels known before it, and the year's long-short portfolio of their scores. All years' trees
    grow side by side; a year uses only its own factors. The library is computed once: for the gates and for the members."""
    panel, places = placed_panel(spark, sf_dir)
    said = SC.evaluated(panel, list(definitions()))
    chosen = pools(said.select("factor", "date", "ic", "slope", "full"))
    by_year: dict[int, list[str]] = {}
    for r in chosen.orderBy("test_year", "place").collect():  # at most the pool's size a year
        by_year.setdefault(r["test_year"], []).append(r["factor"])
    names = tuple(sorted({f for v in by_year.values() for f in v}))
    features = [*names, *MARKET]
    years = spark.createDataFrame([(y, i) for i, y in enumerate(sorted(by_year))], "test_year int, fold int")
    x = training_rows(panel, places, said, names)
    known = SC.known_years(panel.select("date").distinct(), 6)  # a label needs six more rows
    marks = known.join(F.broadcast(years), F.col("known") < F.col("test_year")).groupBy("date").agg(F.sum(F.expr("shiftleft(1, fold)")).cast("int").alias("train"))
    x = x.join(F.broadcast(marks), "date", "left").withColumn("train", F.coalesce("train", F.lit(0)))
    trained = x.where("label IS NOT NULL").join(F.broadcast(years), F.expr("(shiftright(train, fold) & 1) = 1")).groupBy("test_year").agg(F.count(F.lit(1)).alias("n_train"))
    allowed = {i: [features.index(f) for f in [*by_year[y], *MARKET]] for i, y in enumerate(sorted(by_year))}
    fit = T.boost(x.withColumn("valid", F.lit(None).cast("int")), features, KEYS, params=T.Params(rounds=ROUNDS), allowed=allowed)
    test = x.withColumn("test_year", F.year("date")).join(F.broadcast(years), "test_year").join(F.broadcast(trained.where(F.col("n_train") >= LEAST_ROWS)), "test_year")
    p = Written(T.scored(test, fit.model, features, KEYS, F.col("fold"))).df
    scores = panel.join(F.broadcast(p.select(*KEYS, F.col("raw").alias("score"))), KEYS, "left")  # TOP rows a date at most
    first = p.agg(F.min("date").alias("first"))
    runs = P.overlapping(scores.join(F.broadcast(first), F.col("date") >= F.col("first")), HOLD).withColumn("test_year", F.year("date"))
    ic = E.rank_ic(scores).groupBy(F.year("date").alias("test_year")).agg(F.avg("ic").alias("ic_mean"))
    sizes = chosen.groupBy("test_year").agg(F.max("n_passed").alias("n_passed"), F.count(F.lit(1)).alias("pool_size"))
    return out(P.performance(runs, keys=("test_year",)).join(sizes, "test_year").join(trained, "test_year").join(ic, "test_year"), "test_year", "n_passed", "pool_size", "n_train", "annual", "sharpe", "mdd", "n", "ic_mean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return {"yearly_gates": yearly_sql()}
