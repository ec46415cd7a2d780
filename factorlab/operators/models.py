"""Linear models by date, out-of-fold combinations, permutation importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Written
from . import evaluation as E
from . import statistics as S
from . import universe as U


def solved(df: DataFrame, k: int) -> DataFrame:
    """df with x0, x1, ...: the solution of the symmetric system of its columns a00, a10, a11, ... and b0, b1, ..., by a Cholesky
    decomposition in expressions. A column that the ones before it determine gets 0."""
    for j in range(k):
        rest = sum((F.col(f"l{j}{m}") ** 2 for m in range(j)), F.lit(0.0))
        pivot = F.col(f"a{j}{j}") - rest
        df = df.withColumn(f"l{j}{j}", F.when(pivot > 1e-12 * F.col(f"a{j}{j}"), F.sqrt(pivot)))
        below = lambda i: F.col(f"a{i}{j}") - sum((F.col(f"l{i}{m}") * F.col(f"l{j}{m}") for m in range(j)), F.lit(0.0))  # noqa: B023, E731
        df = df.withColumns({f"l{i}{j}": F.coalesce(below(i) / F.col(f"l{j}{j}"), F.lit(0.0)) for i in range(j + 1, k)})
    for j in range(k):
        known = F.col(f"b{j}") - sum((F.col(f"l{j}{m}") * F.col(f"y{m}") for m in range(j)), F.lit(0.0))
        df = df.withColumn(f"y{j}", F.coalesce(known / F.col(f"l{j}{j}"), F.lit(0.0)))
    for j in reversed(range(k)):
        known = F.col(f"y{j}") - sum((F.col(f"l{i}{j}") * F.col(f"x{i}") for i in range(j + 1, k)), F.lit(0.0))
        df = df.withColumn(f"x{j}", F.coalesce(known / F.col(f"l{j}{j}"), F.lit(0.0)))
    return df


def regressions(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """(date, n, x0, x1, ..., c): slopes and constant of the regression on each date, over the rows where all are known. The
    normal equations are aggregates, summed before the shuffle, so no date is one group."""
    known = df.dropna(subset=[y, *xs])
    pair = F.covar_pop if intercept else lambda p, q: F.sum(F.col(p) * F.col(q))
    sums = [pair(xs[i], xs[j]).alias(f"a{i}{j}") for i in range(len(xs)) for j in range(i + 1)] + [pair(x, y).alias(f"b{i}") for i, x in enumerate(xs)]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate([*xs, y])]
    fit = solved(known.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *sums, *means), len(xs))
    c = F.col(f"m{len(xs)}") - sum((F.col(f"x{i}") * F.col(f"m{i}") for i in range(len(xs))), F.lit(0.0))
    return fit.select("date", "n", *(f"x{i}" for i in range(len(xs))), (c if intercept else F.lit(0.0)).alias("c"))


def daily_ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(date, b_<x>...): slopes of a regression with intercept on each date with 2k + 5 rows or more."""
    fit = regressions(df, y, xs).where(F.col("n") >= 2 * len(xs) + 5)
    return fit.select("date", *(F.col(f"x{i}").alias(f"b_{x}") for i, x in enumerate(xs)))


def orthogonal_to(df: DataFrame, y: str, xs: list[str], intercept: bool = True, least: int = 1, keep: bool = False, constant: bool = True) -> DataFrame:
    """df with `residual`: y less its regression on several columns of the same date; null where one is unknown and on dates of
    fewer than `least` such rows (keep: y itself there). Without `constant` the fitted constant stays in the residual."""
    fit = regressions(df, y, xs, intercept)
    fit = fit.select("date", *(F.col(c).alias(f"_fit_{c}") for c in fit.columns if c != "date"))
    part = sum((F.col(f"_fit_x{i}") * F.col(x) for i, x in enumerate(xs)), F.col("_fit_c") if constant else F.lit(0.0))
    known = F.col(y).isNotNull()
    for x in xs:
        known = known & F.col(x).isNotNull()
    value = F.when(known & (F.col("_fit_n") >= least), F.col(y) - part)
    if keep:
        value = F.coalesce(value, F.when(known, F.col(y)))
    return df.join(fit, "date", "left").withColumn("residual", value).select(*df.columns, "residual")


def orthogonal_chain(df: DataFrame, columns: list[str], intercept: bool = False, least: int = 10) -> DataFrame:
    """df with o_<column>: the first column, and of each further one what the ones before it leave, by date."""
    done = df.withColumn(f"o_{columns[0]}", F.col(columns[0]))
    for i, c in enumerate(columns[1:], 1):
        done = orthogonal_to(done, c, [f"o_{x}" for x in columns[:i]], intercept, least).withColumnRenamed("residual", f"o_{c}")
    return done


def out_of_fold(df: DataFrame, scores: list[str], label: str = "label", splits: int = 5, purge: int = 6) -> DataFrame:
    """(fold, symbol, date, pred, label): z-scored columns weighted by the IC ratio that the fold's training dates
    give. df(symbol, date, fwd, label, scores). Weights are a row per fold and score."""
    z = E.zscores(df, scores)
    placed = U.placed_in_folds(z.where(F.col(label).isNotNull()), splits, purge)
    rows = placed.join(z, ["symbol", "date"])
    long = rows.where(F.col("part") == "train").select("fold", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("score")) for s in scores))).alias("x"), "date", "fwd")
    ic = E.rank_ic(long.select(F.struct("fold", "x.s", "date").alias("date"), F.col("x.score").alias("score"), "fwd"))
    ratio = E.ic_summary(ic.select(F.col("date.fold").alias("fold"), F.col("date.s").alias("s"), "ic"), ("fold", "s"))
    weight = ratio.withColumn("w", F.col("ic_ir") / F.sum(F.abs("ic_ir")).over(Window.partitionBy("fold"))).groupBy("fold").pivot("s", scores).agg(F.first("w"))
    weight = weight.select("fold", *(F.col(s).alias(f"w_{s}") for s in scores))
    pred = sum((F.coalesce(F.col(s), F.lit(0.0)) * F.coalesce(F.col(f"w_{s}"), F.lit(0.0)) for s in scores), F.lit(0.0))
    return rows.where(F.col("part") == "validation").join(F.broadcast(weight), "fold").select("fold", "symbol", "date", pred.alias("pred"), label)


def dealt_anew(rows: DataFrame, values: list[str], group: str, item: str, seed: Column) -> DataFrame:
    """rows with moved_<value>: each value dealt anew inside its group, in an order that a portable generator gives. A row
    sends its values to the places they move to, so all values take one shuffle and no join."""
    w, own = Window.partitionBy(group), F.struct(*(c for c in rows.columns if c != group))
    order = {f"_o{k}": F.row_number().over(w.orderBy(S.lcg(seed + k), item)) for k in range(len(values))}
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(item)), **order})
    sent = [F.struct(F.col("_i").alias("place"), own.alias("row"), F.lit(-1).alias("k"), F.lit(None).cast("double").alias("v"))]
    sent += [F.struct(F.col(f"_o{k}").alias("place"), F.when(F.lit(False), own).alias("row"), F.lit(k).alias("k"), F.col(v).alias("v")) for k, v in enumerate(values)]
    got = placed.select(group, F.explode(F.array(*sent)).alias("x")).groupBy(group, "x.place")
    moved = [F.max(F.when(F.col("x.k") == k, F.col("x.v"))).alias(f"moved_{v}") for k, v in enumerate(values)]
    return got.agg(F.first("x.row", ignorenulls=True).alias("row"), *moved).select(group, "row.*", *(f"moved_{v}" for v in values))


def _importance(df: DataFrame, features: list[str], label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature, n, auc, auc_permuted, drop) of the sum of all features, each replaced by its moved_ column in turn."""

    def total(moved: str = "") -> Column:
        p = sum((F.col(f"moved_{x}" if x == moved else x) for x in features), F.lit(0.0))
        return F.rint(p * float(1 << 30)) / float(1 << 30)  # sums that differ in their last bits tie

    df = Written(df).df  # cuts of the ranges and ranks both read it
    variants = F.array(*(F.struct(F.lit(x).alias("feature"), total(x).alias("p")) for x in ("", *features)))
    a = S.auc(df.select(*keys, label, F.explode(variants).alias("x")).select(*keys, label, "x.*"), "p", label, (*keys, "feature"))
    a = a.withColumn("_base", F.max(F.when(F.col("feature") == "", F.col("auc"))).over(Window.partitionBy(*keys)))  # a row a feature
    return a.where(F.col("feature") != "").select(*keys, "feature", "n", F.col("_base").alias("auc"), F.col("auc").alias("auc_permuted"), (F.col("_base") - F.col("auc")).alias("drop"))


def _epoch_day() -> Column:
    return F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")


def permutation_importance(df: DataFrame, scores: list[str], label: str = "label", seed: int = 11) -> DataFrame:
    """(score, auc, auc_permuted, drop) of the equal-weight combination; each score is dealt anew within its date."""
    z = E.zscores(df.where(F.col(label).isNotNull()).dropna(subset=scores), scores).select("symbol", "date", label, *scores)
    moved = dealt_anew(z, scores, "date", "symbol", F.col("symbol").cast("long") * 7919 + _epoch_day() * 104729 + seed)
    return _importance(moved, scores, label).select(F.col("feature").alias("score"), "auc", "auc_permuted", "drop")


def regime_importance(df: DataFrame, scores: list[str], market: list[str], label: str = "label", bins: int = 2, seed: int = 11) -> DataFrame:
    """(regime, feature, n, auc, auc_permuted, drop) by regimes of the first market feature, which are equal widths of its
    mean rank over all rows. Scores are dealt anew within a date, market features among a regime's dates.

    df(symbol, date, label, scores, market): market features have one value a date. Rows without a
    score or the first market feature are left out; other market features that are unknown count as their mean."""
    z = Written(E.zscores(df.where(F.col(label).isNotNull()).dropna(subset=[*scores, market[0]]), scores).select("symbol", "date", label, *scores, *market)).df  # read for the dates' regimes and for the rows
    days = z.groupBy("date").agg(F.count(F.lit(1)).alias("_k"), *(F.max(m).alias(m) for m in market))  # a row a date from here on
    every, value = Window.partitionBy(), F.rint(F.col(market[0]) * float(1 << 30))
    days = days.withColumn("_v", value).withColumns({"_upto": F.sum("_k").over(Window.orderBy("_v")), "_same": F.sum("_k").over(Window.partitionBy("_v"))})
    days = days.withColumn("_r", F.col("_upto") - (F.col("_same") - 1) / 2.0)
    low, high = F.min("_r").over(every), F.max("_r").over(every)
    days = days.withColumn("regime", sum(((F.col("_r") > low + (high - low) * j / bins).cast("int") for j in range(1, bins)), F.lit(0)))
    days = days.withColumns({m: F.coalesce((F.col(m) - F.avg(m).over(every)) / (F.stddev_samp(m).over(every) + 1e-12), F.lit(0.0)) for m in market}).select("regime", "date", *market)
    days = dealt_anew(days, market, "regime", "date", _epoch_day() * 104729 + seed + len(scores))
    moved = dealt_anew(z.drop(*market), scores, "date", "symbol", F.col("symbol").cast("long") * 7919 + _epoch_day() * 104729 + seed)
    return _importance(moved.join(F.broadcast(days), "date"), [*scores, *market], label, ("regime",))
