"""Universes, point-in-time joins, labels, weights and validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import day, history


def as_of(left: DataFrame, right: DataFrame, value: str, effective: str = "effective_date", back_fill: bool = False) -> DataFrame:
    """left(symbol, date, ...) with the latest right value whose effective date isn't later. Union and carry
    forward: one shuffle by symbol, no range join. back_fill gives dates before the first value that value."""
    cols = left.columns
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("_row"))
    b = right.groupBy("symbol", F.col(effective).alias("date")).agg(F.max(value).alias(value)).withColumn("_row", F.lit(0))
    w = Window.partitionBy("symbol").orderBy("date", "_row")
    both = a.unionByName(b, allowMissingColumns=True)
    found = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if back_fill:
        found = F.coalesce(found, F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return both.withColumn("_v", found).where(F.col("_row") == 1).select(*cols, F.col("_v").alias(value))


def statutory_deadline(period_end: Column) -> Column:
    """Last day by which a quarter must be published: 1 May, 1 September, 1 November, 1 May of the next year."""
    year, quarter = F.year(period_end), F.quarter(period_end)
    return F.make_date(year + (quarter == 4).cast("int"), F.element_at(F.array(*map(F.lit, (5, 9, 11, 5))), quarter), F.lit(1))


def effective_date(published: Column, period_end: Column) -> Column:
    """The day after publication, or after the deadline if unknown."""
    return F.date_add(F.coalesce(published, statutory_deadline(period_end)), 1)


def traded_amounts(panel: DataFrame, days: int = 20, listed_rows: int = 252) -> DataFrame:
    """With `_amount`: the mean amount of the last rows, of symbols listed for so many calendar rows and traded today."""
    calendar = Window.partitionBy("symbol").orderBy("date")
    first = F.min(F.when(F.col("close").isNotNull(), F.col("date"))).over(Window.partitionBy("symbol"))
    p = panel.withColumn("_listed", F.sum((F.col("date") >= first).cast("int")).over(calendar.rowsBetween(Window.unboundedPreceding, 0)))
    frame = history().rowsBetween(-(days - 1), 0)
    p = p.withColumn("_mean", F.when(F.count("amount").over(frame) >= max(5, days // 4), F.avg("amount").over(frame)))
    able = (F.col("_listed") >= listed_rows) & (F.coalesce("volume", F.lit(1.0)) > 0) & F.col("close").isNotNull()
    return p.withColumn("_amount", F.when(able, F.rint(F.col("_mean") * 128) / 128)).drop("_listed", "_mean")


def liquid(panel: DataFrame, top: int = 300, days: int = 20, listed_rows: int = 252, dates: DataFrame | None = None) -> DataFrame:
    """With `member`: listed for so many calendar rows, traded today, among the largest mean amounts of the last
    rows. Dates with fewer than `top` amounts have no members. Ties by symbol."""
    p = traded_amounts(panel, days, listed_rows)
    p = p.withColumns({"_place": F.row_number().over(day().orderBy(F.col("_amount").desc_nulls_last(), "symbol")), "_n": F.count("_amount").over(day())})
    return p.withColumn("member", (F.col("_place") <= top) & F.col("_amount").isNotNull() & (F.col("_n") >= top)).drop("_amount", "_place", "_n")


def liquid_places(amounts: DataFrame, top: int = 300) -> DataFrame:
    """(symbol, date, place) of the members that liquid() finds, at most `top` a date; amounts(symbol, date, _amount). Only the keys
    of each partition's `top` largest are shuffled."""
    known = amounts.where(F.col("_amount").isNotNull()).select("symbol", "date", "_amount")
    best = known.withColumn("place", F.row_number().over(day().orderBy(F.col("_amount").desc(), "symbol"))).where(F.col("place") <= top)
    return best.withColumn("_n", F.count(F.lit(1)).over(day())).where(F.col("_n") == top).select("symbol", "date", "place")


def daily_membership(panel: DataFrame, snapshots: DataFrame) -> DataFrame:
    """panel keys with `member` of the latest snapshot; dates before the first one take the first."""
    dates = snapshots.select("snapshot_date").distinct()
    grid = snapshots.select("symbol").distinct().crossJoin(dates).join(snapshots.withColumn("_m", F.lit(True)), ["symbol", "snapshot_date"], "left").select("symbol", "snapshot_date", F.coalesce("_m", F.lit(False)).alias("member"))
    return as_of(panel.select("symbol", "date"), grid, "member", "snapshot_date", back_fill=True).withColumn("member", F.coalesce("member", F.lit(False)))


def labels(df: DataFrame, top: float = 0.2, bottom: float = 0.2, least: int = 5) -> DataFrame:
    """With `label`: 1 from the date's upper quantile of fwd on, 0 up to the lower one (which wins), else null."""
    e = df.groupBy("date").agg(F.percentile("fwd", [bottom, 1 - top]).alias("e"), F.count("fwd").alias("n"))  # a row a date
    x = F.col("fwd")
    label = F.when((F.col("n") >= least) & x.isNotNull(), F.when(x <= F.col("e")[0] + 1e-12, 0).when(x >= F.col("e")[1] - 1e-12, 1))
    return df.join(F.broadcast(e), "date").withColumn("label", label).drop("e", "n")


def balanced_weights(df: DataFrame) -> DataFrame:
    """With `weight` = n / (2 * rows of the same label), over labelled rows."""
    known = df.where(F.col("label").isNotNull())
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("total"))
    return known.join(F.broadcast(counts.crossJoin(total).select("label", (F.col("total") / (2 * F.col("k"))).alias("weight"))), "label")


def purged_folds(n: int, splits: int = 5, purge: int = 6) -> list[tuple[int, int, int, int]]:
    """(fold, end of training, start and end of validation) in places of an ordered sample of n; training is
    expanding and ends `purge` places before the validation."""
    if n < 2 * splits:
        raise ValueError("too few samples for so many splits")
    edge = [int(n * k / (splits + 1)) for k in range(splits + 2)]
    folds = [(k, max(0, edge[k + 1] - purge), edge[k + 1], edge[k + 2] if k + 1 < splits else n) for k in range(splits)]
    return [f for f in folds if f[1] > 0 and f[3] > f[2]]


def placed_in_folds(df: DataFrame, splits: int = 5, purge: int = 6, unit: str = "day") -> DataFrame:
    """(fold, part, date, symbol): train and validation rows; purge counts dates (default) or rows."""
    if unit == "day":
        days = df.select("date").distinct().withColumn("_at", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
        at, n = df.join(F.broadcast(days), "date"), days.count()
    else:  # places in the order of date and symbol: dates' counts give the offsets, so no date meets another
        days = df.groupBy("date").agg(F.count(F.lit(1)).alias("k"))
        days = days.withColumn("_first", F.sum("k").over(Window.orderBy("date")) - F.col("k"))
        at = df.join(F.broadcast(days.drop("k")), "date").withColumn("_at", F.col("_first") + F.row_number().over(day().orderBy("symbol")) - 1)
        n = df.count()
    table = df.sparkSession.createDataFrame(purged_folds(n, splits, purge), "fold int, train_end long, start long, end long")
    part = F.when(F.col("_at") < F.col("train_end"), "train").when((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end")), "validation")
    return at.crossJoin(F.broadcast(table)).withColumn("part", part).where(F.col("part").isNotNull()).select("fold", "part", "date", "symbol")
