"""Backtests: single-asset signals, rebalanced cross-sections, overlapping tranches; and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import day, history

BUY, SELL = 0.00026, 0.00076
#: Round-trip cost of the overlapping portfolio.
ROUND_TRIP = 0.003


def compounded(r: Column, by: Window) -> Column:
    """Running product of 1 + r; unknown returns are skipped and give null at their place."""
    return F.when(r.isNotNull(), F.product(1 + r).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def signal_backtest(df: DataFrame, keys: tuple[str, ...] = ("symbol",), buy: float = BUY, sell: float = SELL) -> DataFrame:
    """df(keys, date, close, signal): position of the day before's signal, net return, equity and benchmark, for
    all keys at once. The first row's net return is unknown, since its trade is."""
    w = Window.partitionBy(*keys).orderBy("date")
    position = F.least(F.greatest(F.coalesce(F.lag("signal").over(w), F.lit(0)), F.lit(0)), F.lit(1)).cast("double")
    d = df.withColumns({"position": position, "ret": F.coalesce(F.try_divide("close", F.lag("close").over(w)) - 1, F.lit(0.0))})
    d = d.withColumn("trade", F.col("position") - F.lag("position").over(w))
    d = d.withColumn("net", F.col("position") * F.col("ret") - F.greatest("trade", F.lit(0.0)) * buy - F.greatest(-F.col("trade"), F.lit(0.0)) * sell)
    d = d.withColumn("net", F.when(F.col("trade").isNotNull(), F.col("net")))
    return d.withColumns({"equity": compounded(F.col("net"), w), "benchmark": compounded(F.col("ret"), w)})


def metrics(curve: DataFrame, keys: tuple[str, ...] = (), net: str = "net", equity: str = "equity") -> DataFrame:
    """Total and annual return, Sharpe ratio over 2 % a year, drawdown and number of trades of each curve."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = curve.withColumn("_dd", F.col(equity) / F.max(equity).over(w) - 1)
    trades = F.sum(F.abs("trade")).cast("long") if "trade" in curve.columns else F.lit(None).cast("long")
    out = c.groupBy(*keys).agg(
        F.max_by(equity, "date").alias("last"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"), (F.avg(net) - 0.02 / 252).alias("m"), F.stddev_samp(net).alias("s"), F.min("_dd").alias("max_drawdown"), trades.alias("n_trades")
    )
    return out.select(
        *keys, (F.col("last") - 1).alias("total_return"), F.when(F.col("years") > 0, F.pow("last", 1 / F.col("years")) - 1).otherwise(0.0).alias("ann_return"),
        F.when(F.col("s") > 1e-12, F.sqrt(F.lit(252.0)) * F.col("m") / F.col("s")).otherwise(0.0).alias("sharpe"), "max_drawdown", "n_trades",
    )


def crossover(bars: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(symbol, date, close, fast, slow, signal) for all parameter pairs: each length is averaged once."""
    lengths = sorted({n for p in pairs for n in p})
    frame = lambda n: history().rowsBetween(-(n - 1), 0)
    means = bars.select("symbol", "date", "close", F.create_map(*(x for n in lengths for x in (F.lit(n), F.when(F.count("close").over(frame(n)) == n, F.avg("close").over(frame(n)))))).alias("m"))
    grid = bars.sparkSession.createDataFrame(pairs, "fast int, slow int")
    signal = F.coalesce(F.col("m")[F.col("fast")] > F.col("m")[F.col("slow")] + 1e-9, F.lit(False)).cast("int")
    return means.crossJoin(F.broadcast(grid)).select("symbol", "date", "close", "fast", "slow", signal.alias("signal"))


def rebalance_dates(dates: DataFrame, every: str = "monthly") -> DataFrame:
    """(rb, next): the last date of each month, ISO week or quarter, and the one after (or the last date)."""
    key = {"monthly": F.date_trunc("month", "date"), "weekly": F.date_trunc("week", "date"), "quarterly": F.date_trunc("quarter", "date")}[every]
    d = dates.select("date").distinct().groupBy(key.alias("k")).agg(F.max("date").alias("rb"))
    order = Window.orderBy("rb")  # a row a period
    last = F.max("rb").over(Window.partitionBy())
    return d.select("rb", F.coalesce(F.lead("rb").over(order), last).alias("next"))


def section_weights(df: DataFrame, schedule: DataFrame, top: float = 0.2, bottom: float | None = None) -> DataFrame:
    """(symbol, rb, next, w): equal weights of the best (and worst) shares at each rebalance date. Ties by symbol.
    A date with too few names holds nothing."""
    f = df.where(F.col("score").isNotNull()).join(F.broadcast(schedule), df["date"] == schedule["rb"])
    best, worst = day().orderBy(F.col("score").desc(), "symbol"), day().orderBy(F.col("score").asc(), F.col("symbol").desc())
    f = f.withColumns({"_n": F.count(F.lit(1)).over(day()), "_hi": F.row_number().over(best), "_lo": F.row_number().over(worst)})
    n_long = F.greatest(F.lit(1), F.floor(F.col("_n") * top))
    n_short = F.lit(0) if bottom is None else F.greatest(F.lit(1), F.floor(F.col("_n") * bottom))
    w = F.when((n_short > 0) & (F.col("_lo") <= n_short), -1.0 / n_short).when(F.col("_hi") <= n_long, 1.0 / n_long)
    return f.where(F.col("_n") >= n_long + n_short + 1).withColumn("w", w).where(F.col("w").isNotNull()).select("symbol", "rb", "next", "w")


def delisted(panel: DataFrame, delistings: DataFrame) -> DataFrame:
    """panel(symbol, date, close, ret) with the return of the delisting date at the liquidation price (90 % of the
    close if unknown) and none after it. delistings(symbol, delist_date, liquidation_price) is a small dimension."""
    d = panel.join(F.broadcast(delistings), "symbol", "left")
    before = F.lag("close").over(history())
    price = F.coalesce("liquidation_price", F.col("close") * 0.9)
    at = F.col("date") == F.col("delist_date")
    ret = F.when(F.col("date") > F.col("delist_date"), None).when(at & before.isNotNull(), price / before - 1).otherwise(F.col("ret"))
    return d.withColumn("_r", ret).withColumns({"ret": F.col("_r"), "close": F.when(F.col("date") > F.col("delist_date"), None).when(at, price).otherwise(F.col("close"))}).drop("_r", "delist_date", "liquidation_price")


def section_backtest(panel: DataFrame, weights: DataFrame, schedule: DataFrame, buy: float = BUY, sell: float = SELL) -> DataFrame:
    """(date, gross, cost, net, bench, equity, benchmark, turnover): weights hold from the day after rb to next.

    Costs fall on the day after the rebalance: half of the absolute change buys, half sells."""
    p = panel.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    days = p.select("date").distinct()
    held = days.join(F.broadcast(schedule), (days["date"] > F.col("rb")) & (days["date"] <= F.col("next"))).select("date", "rb")
    daily = p.join(F.broadcast(held), "date", "left").join(weights.select("symbol", "rb", "w"), ["symbol", "rb"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    daily = daily.withColumn("_dw", F.abs(F.col("w") - F.lag("w").over(history())))
    c = daily.groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"), F.avg("ret").alias("bench"), F.sum("_dw").alias("turnover"))
    order = Window.orderBy("date")  # a row a date
    c = c.join(F.broadcast(schedule.select("rb")), c["date"] == F.col("rb"), "left").withColumn("_after", F.lag("rb").over(order).isNotNull())
    c = c.withColumn("cost", F.when(F.col("_after"), F.col("turnover") / 2 * (buy + sell)).otherwise(0.0)).withColumn("net", F.col("gross") - F.col("cost"))
    return c.select("date", "gross", "cost", "net", "bench", compounded(F.col("net"), order).alias("equity"), compounded(F.col("bench"), order).alias("benchmark"), "turnover")


def section_scan(panel: DataFrame, scores: DataFrame, schedule: DataFrame, shares: list[float], keys: tuple[str, ...] = ("delta",), buy: float = BUY, sell: float = SELL) -> DataFrame:
    """(keys, share, date, net, bench, equity): long-only backtests of every key and share at once. panel(symbol, date,
    ret), scores(keys, symbol, date, score). Only rows that are held are joined with returns; costs come from the
    weights' changes at a rebalance. A date with too few names holds nothing. Ties by symbol."""
    cell = (*keys, "share")
    section = Window.partitionBy(*keys, "rb")
    f = scores.where(F.col("score").isNotNull()).join(F.broadcast(schedule), F.col("date") == F.col("rb"))
    f = f.withColumns({"_n": F.count(F.lit(1)).over(section), "_hi": F.row_number().over(section.orderBy(F.col("score").desc(), "symbol"))})
    f = f.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("_l", F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("share"))))
    held = f.where((F.col("_hi") <= F.col("_l")) & (F.col("_n") > F.col("_l"))).select(*cell, "symbol", "rb", "next", (1.0 / F.col("_l")).alias("w"))
    p = panel.select("symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    bench = p.groupBy("date").agg(F.avg("ret").alias("bench"))
    days = bench.join(F.broadcast(schedule), (F.col("date") > F.col("rb")) & (F.col("date") <= F.col("next")), "left").drop("next")
    days = days.join(F.broadcast(schedule.select(F.col("rb").alias("_rb"))), F.col("date") == F.col("_rb"), "left")
    days = days.withColumn("at", F.lag("_rb").over(Window.orderBy("date"))).drop("_rb")  # a row a date: what was rebalanced the day before
    gross = held.join(p.join(F.broadcast(days.select("date", "rb")), "date"), ["symbol", "rb"]).groupBy(*cell, "date").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"))
    change = F.explode(F.array(F.struct(F.col("rb").alias("at"), F.col("w").alias("w")), F.struct(F.col("next").alias("at"), (-F.col("w")).alias("w"))))
    moves = held.select(*cell, "symbol", change.alias("x")).groupBy(*cell, "symbol", "x.at").agg(F.sum("x.w").alias("d")).groupBy(*cell, "at").agg(F.sum(F.abs("d")).alias("turnover"))
    cells = scores.select(*keys).distinct().withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    c = days.crossJoin(F.broadcast(cells)).join(gross, [*cell, "date"], "left").join(moves, [*cell, "at"], "left")  # a row a date and parameter set
    c = c.withColumn("net", F.coalesce("gross", F.lit(0.0)) - F.coalesce("turnover", F.lit(0.0)) / 2 * (buy + sell))
    return c.select(*cell, "date", "net", "bench", compounded(F.col("net"), Window.partitionBy(*cell).orderBy("date")).alias("equity"))


def target_weights(df: DataFrame, top: float = 0.2, bottom: float = 0.2, long_only: bool = False) -> DataFrame:
    """With `target`: equal weights of scores beyond the date's quantiles, ties included, the lower side winning."""
    e = df.groupBy("date").agg(F.percentile("score", [bottom, 1 - top]).alias("e"), F.count("score").alias("n"))
    least = max(int(1 / top), int(1 / bottom)) * 3
    d = df.join(e, "date").withColumns({"_up": F.coalesce(F.col("score") >= F.col("e")[1] - 1e-12, F.lit(False)), "_down": F.coalesce(F.col("score") <= F.col("e")[0] + 1e-12, F.lit(False))})
    d = d.withColumns({"_nu": F.sum(F.col("_up").cast("int")).over(day()), "_nd": F.sum(F.col("_down").cast("int")).over(day())})
    w = F.when(F.lit(not long_only) & F.col("_down"), -1.0 / F.col("_nd")).when(F.col("_up"), 1.0 / F.col("_nu")).otherwise(0.0)
    return d.withColumn("target", F.when(F.col("n") >= least, w).otherwise(0.0)).drop("e", "n", "_up", "_down", "_nu", "_nd")


def overlapping(df: DataFrame, days: int = 5, cost: float = ROUND_TRIP, scale: DataFrame | None = None, **how) -> DataFrame:
    """(date, port_ret, turnover, cum): the mean of the last `days` target weights is held; its holding of the day
    before earns close(t+2) / close(t+1) - 1; changes cost half a round trip; the first rows are dropped."""
    d = target_weights(df, **how).withColumn("r", F.try_divide(F.lead("close", 2).over(history()), F.lead("close", 1).over(history())) - 1)
    d = d.withColumn("held", F.avg("target").over(history().rowsBetween(-(days - 1), 0)))
    if scale is not None:
        d = d.join(F.broadcast(scale), "date", "left").withColumn("held", F.col("held") * F.coalesce("scale", F.lit(1.0))).drop("scale")
    d = d.withColumn("_before", F.lag("held").over(history()))
    c = d.groupBy("date").agg(F.sum(F.col("_before") * F.col("r")).alias("gross"), F.sum(F.abs(F.col("held") - F.col("_before"))).alias("turnover"))
    order = Window.orderBy("date")  # a row a date
    c = c.withColumns({"port_ret": F.col("gross") - F.coalesce("turnover", F.lit(0.0)) * cost / 2, "_i": F.row_number().over(order)})
    c = c.where((F.col("_i") > days) & F.col("port_ret").isNotNull())
    return c.select("date", "port_ret", F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.product(1 + F.col("port_ret")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))


def performance(returns: DataFrame, r: str = "port_ret", keys: tuple[str, ...] = ()) -> DataFrame:
    """Annual return of the mean, Sharpe ratio, maximal drawdown, number of returns."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = returns.where(F.col(r).isNotNull()).withColumn("_c", F.product(1 + F.col(r)).over(w))
    c = c.withColumn("_dd", F.col("_c") / F.max("_c").over(w) - 1)
    g = c.groupBy(*keys).agg(F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.min("_dd").alias("mdd"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, (F.pow(1 + F.col("m"), F.lit(252.0)) - 1).alias("annual"), F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"), "mdd", "n")


def naive_overlapping(df: DataFrame, days: int = 5, cost: float = ROUND_TRIP, top: float = 0.2, bottom: float = 0.2) -> DataFrame:
    """The smoothed counter-example: a rolling mean of each signal's own return, which understates risk."""
    d = df.withColumn("r", F.try_divide(F.lead("close", 2).over(history()), F.lead("close", 1).over(history())) - 1).where(F.col("r").isNotNull() & F.col("score").isNotNull())
    e = d.groupBy("date").agg(F.percentile("score", [bottom, 1 - top]).alias("e"), F.count(F.lit(1)).alias("n"))
    d = d.join(e, "date").groupBy("date").agg((F.avg(F.when(F.col("score") >= F.col("e")[1] - 1e-12, F.col("r"))) - F.avg(F.when(F.col("score") <= F.col("e")[0] + 1e-12, F.col("r")))).alias("s"), F.first("n").alias("n"))
    d = df.select("date").distinct().join(d.withColumn("s", F.when(F.col("n") >= max(int(1 / top), int(1 / bottom)) * 3, F.col("s"))), "date", "left")
    frame = Window.orderBy("date").rowsBetween(-(days - 1), 0)  # a row a date
    return d.select("date", (F.when(F.count("s").over(frame) == days, F.avg("s").over(frame)) - 2 * cost / days).alias("port_ret")).where(F.col("port_ret").isNotNull())


def monthly(returns: DataFrame, r: str = "port_ret") -> DataFrame:
    return returns.groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg((F.product(1 + F.col(r)) - 1).alias("ret"))


