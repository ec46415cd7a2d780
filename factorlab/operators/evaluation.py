"""Factor evaluation on long frames (symbol, date, score, ...): ranks, information coefficients, buckets, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Round-trip cost of a long-short pair: both opens, both closes, two slippages.
PAIR_COST = 2 * (0.00026 + 0.00076) + 2 * 0.0005


def history() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def day() -> WindowSpec:
    return Window.partitionBy("date")


def padded_returns(panel: DataFrame, pad: bool = True) -> DataFrame:
    """With `ret`: change of the close; gaps carry the last close forward (pad) or give null."""
    price = F.last("close", ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, 0)) if pad else F.col("close")
    return panel.withColumn("_pad", price).withColumn("ret", F.try_divide("_pad", F.lag("_pad").over(history())) - 1).drop("_pad")


def next_returns(panel: DataFrame) -> DataFrame:
    """With `fwd`: the next row's return, unknown ones being 0."""
    return panel.withColumn("fwd", F.coalesce(F.lead(F.coalesce("ret", F.lit(0.0))).over(history()), F.lit(0.0)))


def horizon_returns(panel: DataFrame, days: int = 5) -> DataFrame:
    """With `fwd`: bought at the next close and held for so many rows."""
    return panel.withColumn("fwd", F.try_divide(F.lead("close", days + 1).over(history()), F.lead("close", 1).over(history())) - 1)


def mean_rank(x: str) -> Column:
    """Rank within the date, ties by their mean; for known values only."""
    w = day().orderBy(F.col(x))
    return (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))) / 2.0


def correlation(x: str, y: str) -> Column:
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))


def rank_ic(df: DataFrame, score: str = "score", least: int = 10) -> DataFrame:
    """(date, ic): correlation of the ranks of score and fwd over rows that have both, on dates with enough."""
    both = df.where(F.col(score).isNotNull() & F.col("fwd").isNotNull())
    ranked = both.select("date", mean_rank(score).alias("rs"), mean_rank("fwd").alias("rf"))
    return ranked.groupBy("date").agg(correlation("rs", "rf").alias("ic"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & F.col("ic").isNotNull()).select("date", "ic")


def ic_summary(ic: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    out = ic.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.count("ic").alias("ic_days"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"))
    ratio = F.try_divide("ic_mean", "ic_std")
    return out.withColumns({"ic_ir": ratio, "ic_t": ratio * F.sqrt("ic_days")})


def fama_macbeth_daily(df: DataFrame, score: str = "score", least: int = 10) -> DataFrame:
    """(date, slope): sample covariance over population variance, as the factors' slopes are defined."""
    both = df.where(F.col(score).isNotNull() & F.col("fwd").isNotNull())
    g = both.groupBy("date").agg(F.covar_samp(score, "fwd").alias("c"), F.var_pop(score).alias("v"), F.count(F.lit(1)).alias("n"))
    return g.where((F.col("n") >= least) & (F.col("v") >= 1e-12)).select("date", (F.col("c") / F.col("v")).alias("slope"))


def fama_macbeth(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    out = daily.groupBy(*by).agg(F.avg("slope").alias("m"), F.stddev_pop("slope").alias("s"), F.count("slope").alias("fm_days"))
    return out.select(*by, (F.col("m") * 252).alias("lambda_annual"), (F.try_divide("m", "s") * F.sqrt("fm_days")).alias("fm_t"), "fm_days")


def binned(df: DataFrame, score: str = "score", bins: int = 5, least: int = 15) -> DataFrame:
    """With `bin` from 0: quantile groups of each date by linear edges, right-closed, equal edges merged."""
    known = df.where(F.col(score).isNotNull())
    shares = [k / bins for k in range(bins + 1)]
    edges = known.groupBy("date").agg(F.array_distinct(F.percentile(score, shares)).alias("edges"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)  # a row a date
    below = F.size(F.filter("edges", lambda e: e < F.col(score) - 1e-9))
    return known.join(F.broadcast(edges), "date").withColumn("bin", F.greatest(below - 1, F.lit(0))).drop("edges", "n")


def quantile_returns(df: DataFrame, score: str = "score", bins: int = 5) -> DataFrame:
    """(date, q1..): mean fwd of each group."""
    b = binned(df.where(F.col("fwd").isNotNull()), score, bins)
    return b.groupBy("date").agg(*(F.avg(F.when(F.col("bin") == k, F.col("fwd"))).alias(f"q{k + 1}") for k in range(bins)))


def long_short_curve(quantiles: DataFrame, bins: int = 5, cost: float = PAIR_COST) -> DataFrame:
    """(date, ls_ret, ls_cum): top less bottom group less cost, compounded; a single ordered series."""
    r = quantiles.select("date", (F.col(f"q{bins}") - F.col("q1") - cost).alias("ls_ret"))
    return r.withColumn("ls_cum", F.product(1 + F.coalesce("ls_ret", F.lit(0.0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def effective_ratio(df: DataFrame, score: str = "score", bins: int = 5) -> DataFrame:
    """Share of dates whose quantile groups are all there."""
    d = binned(df, score, bins).groupBy("date").agg((F.countDistinct("bin") == bins).cast("double").alias("full"))
    return d.agg(F.avg("full").alias("cs_effective_ratio"), F.count(F.lit(1)).alias("cs_days"))


def gates(metrics: DataFrame, ir: float = 0.05, t: float = 2.0, ratio: float = 0.5) -> DataFrame:
    """Marks factors that pass all three gates."""
    parts = {"ic_pass": F.abs("ic_ir") > ir, "fm_pass": F.abs("fm_t") > t, "cs_pass": F.col("cs_effective_ratio") > ratio}
    return metrics.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in parts.items()}).withColumn("passed", F.col("ic_pass") & F.col("fm_pass") & F.col("cs_pass"))


def ic_correlation(ics: DataFrame) -> DataFrame:
    """ics(factor, date, ic); (factor_a, factor_b, corr) over the dates that all factors have."""
    n = ics.select("factor").distinct().count()
    whole = ics.join(ics.groupBy("date").agg(F.count("ic").alias("k")).where(F.col("k") == n), "date")
    a = whole.select("date", F.col("factor").alias("factor_a"), F.col("ic").alias("x"))
    b = whole.select("date", F.col("factor").alias("factor_b"), F.col("ic").alias("y"))
    return a.join(b, "date").groupBy("factor_a", "factor_b").agg(correlation("x", "y").alias("corr"))


def greedy_pool(metrics: list[tuple[str, float]], corr: dict[tuple[str, str], float], forced: list[str] | None = None, most: float = 0.8) -> list[str]:
    """Factors by falling |IC_IR|, forced ones first, each dropped if it correlates above `most` with one kept.
    A sequential rule over at most a few hundred factors, so it runs on the driver."""
    kept: list[str] = []
    order = list(forced or []) + [f for f, _ in sorted(metrics, key=lambda m: (-abs(m[1]), m[0])) if f not in (forced or [])]
    for f in order:
        if f in (forced or []) or all(abs(corr.get((f, k), corr.get((k, f), 0.0)) or 0.0) <= most for k in kept):
            kept.append(f)
    return kept


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Within each date: less the mean, over the sample deviation + 1e-12."""
    return df.withColumns({c: (F.col(c) - F.avg(c).over(day())) / (F.stddev_samp(c).over(day()) + 1e-12) for c in columns})


def combined(df: DataFrame, weights: dict[str, float]) -> Column:
    """Weighted sum, weights normalised by their absolute sum; null if any part is."""
    total = sum(abs(w) for w in weights.values()) or 1.0
    return sum((F.col(c) * (w / total) for c, w in sorted(weights.items())), F.lit(0.0))


def orthogonal(df: DataFrame, y: str, x: str, least: int = 20) -> DataFrame:
    """With `residual`: y less its regression on x within the date (with intercept); y itself on small dates."""
    u, v = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y))
    slope = F.when(F.min(u).over(day()) < F.max(u).over(day()), F.covar_pop(v, u).over(day()) / F.var_pop(u).over(day()))
    fitted = F.avg(v).over(day()) + F.coalesce(slope, F.lit(0.0)) * (u - F.avg(u).over(day()))
    return df.withColumn("residual", F.when(u.isNotNull(), F.when(F.count(u).over(day()) >= least, v - fitted).otherwise(v)))
