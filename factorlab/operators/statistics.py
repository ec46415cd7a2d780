"""Attribution and significance: CAPM, Newey-West, risk measures, bootstraps, classification scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluation import day, history


def moving_moments(x: np.ndarray, y: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's window of up to so many rows: their number, sample covariance of x and y, sample variance of y. All windows
    take their rows in order, as aggregates do, oldest first and side by side."""
    n, mx, my, c, v = np.zeros((5, len(x)))
    for k in range(min(rows, len(x)) - 1, -1, -1):
        to, u, w = slice(k, None), x[: len(x) - k], y[: len(x) - k]
        n[to] += 1
        dx, dy = u - mx[to], w - my[to]
        step = dy / n[to]
        mx[to] += dx / n[to]
        my[to] += step
        c[to] += dx * (w - my[to])
        v[to] += dy * (dy - step)
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, c / (n - 1), v / (n - 1)


def moving_sum(x: np.ndarray, rows: int) -> np.ndarray:
    """Sums of each row and up to rows - 1 before it."""
    s = np.zeros(len(x))
    for k in range(min(rows, len(x)) - 1, -1, -1):
        s[k:] += x[: len(x) - k]
    return s


def residual_momentum(panel: DataFrame, window: int = 252, period: int = 60, least: int = 120) -> DataFrame:
    """panel(symbol, date, ret); `momentum`: rolling sum of returns less beta times the date's mean return. A symbol's windows
    are summed side by side in one group; Spark's moving frames add a window's rows one by one for every row."""
    r = F.coalesce("ret", F.lit(0.0))
    p = panel.withColumn("_r", r).withColumn("_m", F.avg(r).over(day()))

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        r, m = (rows.column(c).to_numpy() for c in ("_r", "_m"))
        n, c, v = moving_moments(r, m, window)
        known = (n >= least) & (v > 0)
        e = np.where(known, r - np.divide(c, v, out=np.zeros(len(r)), where=known) * m, 0.0)
        enough = moving_sum(known.astype(float), period) >= min(period, least)
        return rows.drop_columns(["_r", "_m"]).append_column("momentum", pa.array(moving_sum(e, period), mask=~enough))

    return p.groupBy("symbol").applyInArrow(work, T.StructType([*panel.schema.fields, T.StructField("momentum", T.DoubleType())]))


def high_52w(panel: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """`nearness`: close over the highest close of the window."""
    frame = history().rowsBetween(-(window - 1), 0)
    top = F.when(F.count("close").over(frame) >= least, F.max("close").over(frame))
    return panel.withColumn("nearness", F.when(top != 0, F.col("close") / top))


def market_features(panel: DataFrame, short: int = 20, long: int = 252) -> DataFrame:
    """(date, market_vol_20d, market_turnover_20d): members' mean deviation of returns, and mean short over long volume."""
    s, f = history().rowsBetween(-(short - 1), 0), history().rowsBetween(-(long - 1), 0)
    vol = F.when(F.count("ret").over(s) == short, F.stddev_samp("ret").over(s))
    mean = lambda w, n: F.when(F.count("volume").over(w) == n, F.avg("volume").over(w))
    p = panel.select("date", "member", vol.alias("_v"), F.try_divide(mean(s, short), mean(f, long)).alias("_t"))
    return p.groupBy("date").agg(F.avg(F.when(F.col("member"), F.col("_v"))).alias("market_vol_20d"), F.avg(F.when(F.col("member"), F.col("_t"))).alias("market_turnover_20d"))


def capm_mixed(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """df(keys, y, x): beta as sample covariance over population variance, alpha, and R squared of its residuals."""
    g = df.groupBy(*keys).agg(F.covar_samp("y", "x").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("y", "x").alias("cp"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.count(F.lit(1)).alias("n"))
    b = F.try_divide("c", "vx")
    residual = F.col("vy") - 2 * F.col("beta") * F.col("cp") + F.col("beta") ** 2 * F.col("vx")
    return g.withColumn("beta", b).select(*keys, "beta", (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), (1 - F.try_divide(residual, F.col("vy"))).alias("r2"), "n")


def capm(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """df(keys, y, x) of excess returns: least squares with t values of alpha and beta, and R squared."""
    g = df.groupBy(*keys).agg(F.covar_pop("y", "x").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("beta", F.try_divide("c", "vx")).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    sse = F.col("n") * (F.col("vy") - F.col("beta") * F.col("c"))
    g = g.withColumn("s2", F.try_divide(sse, F.col("n") - 2))
    t_beta = F.try_divide(F.col("beta"), F.sqrt(F.col("s2") / (F.col("n") * F.col("vx"))))
    t_alpha = F.try_divide(F.col("alpha"), F.sqrt(F.col("s2") * (1 / F.col("n") + F.col("mx") ** 2 / (F.col("n") * F.col("vx")))))
    return g.select(*keys, "alpha", "beta", t_alpha.alias("t_alpha"), t_beta.alias("t_beta"), (F.col("beta") * F.col("c") / F.col("vy")).alias("r2"), "n")


def rolling_capm(df: DataFrame, rows: int = 252, keys: tuple[str, ...] = ()) -> DataFrame:
    """alpha and beta from the previous rows, the current one left out."""
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(-rows, -1)
    full = F.count("y").over(frame) == rows
    d = df.withColumn("beta", F.when(full, F.covar_pop("y", "x").over(frame) / F.var_pop("x").over(frame)))
    return d.withColumn("alpha", F.when(full, F.avg("y").over(frame) - F.col("beta") * F.avg("x").over(frame)))


def newey_west(df: DataFrame, r: str, lags: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sharpe ratio with the Bartlett-weighted long-run variance, and the plain one."""
    w = Window.partitionBy(*keys).orderBy("date")
    d = df.withColumn("_u", F.col(r) - F.avg(r).over(Window.partitionBy(*keys)))
    d = d.withColumns({f"_p{k}": F.col("_u") * F.lag("_u", k).over(w) if k else F.col("_u") ** 2 for k in range(lags + 1)})
    g = d.groupBy(*keys).agg(F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.count(r).alias("n"), *(F.sum(f"_p{k}").alias(f"g{k}") for k in range(lags + 1)))
    long_run = sum(((2 * (1 - k / (lags + 1)) if k else 1.0) * F.col(f"g{k}") for k in range(lags + 1)), F.lit(0.0)) / F.col("n")
    return g.select(*keys, (F.try_divide("m", "s") * F.sqrt(F.lit(252.0))).alias("sharpe"), F.when(long_run > 0, F.col("m") / F.sqrt(long_run) * F.sqrt(F.lit(252.0))).alias("nw_sharpe"), "n")


def risk(df: DataFrame, r: str, keys: tuple[str, ...] = (), level: float = 0.05) -> DataFrame:
    """Value at risk (quantile), the mean beyond it, and the autocorrelation at lag 1."""
    q = df.groupBy(*keys).agg(F.percentile(r, level).alias("var"))
    d = df.withColumn("_l", F.lag(r).over(Window.partitionBy(*keys).orderBy("date")))
    d = d.join(q, list(keys)) if keys else d.crossJoin(F.broadcast(q))
    return d.groupBy(*keys, "var").agg(F.avg(F.when(F.col(r) <= F.col("var") + 1e-15, F.col(r))).alias("cvar"), F.corr(F.when(F.col("_l").isNotNull(), F.col(r)), "_l").alias("autocorr"))


def lcg(seed: Column, step: int = 1) -> Column:
    """Portable pseudo-random 31-bit integers: any engine with 64-bit integers gives the same."""
    x = (seed * 48271 + step * 69621 + 11) % 2147483647
    return (x * 16807 + 7) % 2147483647


def block_bootstrap(returns: DataFrame, r: str, reps: int = 10_000, block: int = 20, seed: int = 42) -> DataFrame:
    """(rep, sharpe) of samples of whole blocks, as long as the series. Starts come from lcg(); the series, a row a
    date, is numbered and joined by place."""
    order = Window.orderBy("date")
    s = returns.where(F.col(r).isNotNull()).select((F.row_number().over(order) - 1).cast("long").alias("i"), F.col(r).alias("r"))
    n = s.count()
    blocks = -(-n // block)
    draws = returns.sparkSession.range(reps * blocks).select((F.col("id") % reps).alias("rep"), F.floor(F.col("id") / reps).cast("long").alias("k"))
    draws = draws.withColumn("start", lcg(F.col("rep") * 7919 + F.col("k") * 104729 + seed) % (n - block + 1))
    rows = draws.select("rep", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"), "k", "start").where(F.col("k") * block + F.col("j") < n)
    g = rows.withColumn("i", F.col("start") + F.col("j")).join(s, "i").groupBy("rep").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    return g.select("rep", F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"))


def iid_bootstrap(df: DataFrame, r: str, reps: int = 200, seed: int = 7, key: str = "symbol") -> DataFrame:
    """(key, rep, m): mean of as many returns as the key has, drawn with replacement. A key's series is one group and its
    samples are drawn beside it, so rows aren't multiplied by the samples before a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def work(rows: pa.Table) -> pa.Table:
        x = rows.sort_by("date").column("r").to_numpy()
        own, rep = rows.column(key).slice(0, 1).to_pylist(), np.arange(reps)
        start, means = (own[0] * 15485863 + seed) % 2147483647, np.empty(reps)
        for some in np.array_split(rep, max(1, reps * len(x) >> 20)):  # about a million draws at a time
            means[some] = x[lcg_numpy((some * 7919)[:, None] + np.arange(len(x)) * 104729 + start) % len(x)].mean(1)
        return pa.table([pa.array(own * reps, rows.schema.field(key).type), pa.array(rep), pa.array(means)], names=[key, "rep", "m"])

    return df.where(F.col(r).isNotNull()).select(key, "date", F.col(r).cast("double").alias("r")).groupBy(key).applyInArrow(work, f"{key} {kind}, rep long, m double")


def percentile_of(df: DataFrame, sample: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean percentage rank of a value in a sample: below and up to it, averaged."""
    g = df.groupBy(*keys).agg(F.sum((F.col(sample) < F.col(value)).cast("long")).alias("a"), F.sum((F.col(sample) <= F.col(value)).cast("long")).alias("b"), F.count(sample).alias("n"))
    return g.select(*keys, (100.0 * (F.col("a") + F.col("b") + (F.col("b") > F.col("a")).cast("int")) / (2 * F.col("n"))).alias("percentile"))


def auc(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = (), parts: int = 200) -> DataFrame:
    """Area under the ROC curve by mean ranks. Scores are counted, cut into ranges of about equally many rows, ranked
    inside each and lifted by what the ranges below hold, so that no task sees all rows of a key."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*keys, F.col(score).alias("_s"), F.col(label).alias("_l"))
    cells = known.groupBy(*keys, "_s").agg(F.sum((F.col("_l") == 1).cast("long")).alias("p"), F.sum((F.col("_l") == 0).cast("long")).alias("q"), F.count(F.lit(1)).alias("k"))
    edges = known.agg(F.percentile_approx("_s", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = F.lit(0)
    if edges:
        part = F.aggregate(F.array(*map(F.lit, sorted(set(edges)))), F.lit(0), lambda n, e: n + (F.col("_s") >= e).cast("int"))
    cells = cells.withColumn("_part", part)
    below = cells.groupBy(*keys, "_part").agg(F.sum("k").alias("_k"))
    below = below.withColumn("_below", F.sum("_k").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_k")).drop("_k")  # a row a range
    inside = F.sum("k").over(Window.partitionBy(*keys, "_part").orderBy("_s"))
    ranked = cells.withColumn("_upto", inside).join(F.broadcast(below) if not keys else below, [*keys, "_part"])
    rank = F.col("_below") + F.col("_upto") - (F.col("k") - 1) / 2.0
    g = ranked.groupBy(*keys).agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return g.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"), (F.col("p") + F.col("q")).alias("n"))


def tail(t: float, df: float) -> float:
    """Two-sided p value of Student's t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    swap = x > (a + 1.0) / (a + b + 2.0)
    if swap:
        x, a, b = 1.0 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0.0 else 0.0
    c, d, out = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0)), 0.0
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / (1.0 + step * d), 1.0 + step / c
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    part = front * out / a
    return 1.0 - part if swap else part


def p_values(t: Column, df: Column) -> Column:
    """Two-sided p values, a row a regression."""

    def work(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([tail(x, max(n, 1.0)) if x == x else None for x, n in zip(ts, ns, strict=True)], dtype="float64")

    return F.pandas_udf(work, "double")(t, df)


def block_sharpes(returns: DataFrame, r: str, key: str, reps: int = 1000, block: int = 20, seed: int = 42) -> DataFrame:
    """(key, rep, sharpe) of samples of floor(n / block) whole blocks that begin before n - block; series of up to a
    block are drawn row by row. One series is one group."""
    schema = T.StructType([returns.schema[key], T.StructField("rep", T.IntegerType()), T.StructField("sharpe", T.DoubleType())])

    def work(rows: pa.Table) -> pa.Table:
        x = rows.sort_by("date").column(r).to_numpy()
        n = len(x)
        size = n if n <= block else n // block
        draw = lcg_numpy(np.arange(reps)[:, None] * 7919 + np.arange(size) * 104729 + seed)
        sample = x[draw % n] if n <= block else x[(draw % (n - block))[:, :, None] + np.arange(block)].reshape(reps, -1)
        s = sample.std(1)
        sharpe = np.where((s > 1e-12) & (n >= 10), np.sqrt(252.0) * sample.mean(1) / np.where(s > 1e-12, s, 1.0), 0.0)
        return pa.table({key: pa.array(rows.column(key).to_pylist()[:1] * reps), "rep": pa.array(np.arange(reps), pa.int32()), "sharpe": pa.array(sharpe)})

    return returns.where(F.col(r).isNotNull()).select(key, "date", r).groupBy(key).applyInArrow(work, schema)


def lcg_numpy(seed: np.ndarray, step: int = 1) -> np.ndarray:
    """lcg() over an array."""
    return ((seed.astype(np.int64) * 48271 + step * 69621 + 11) % 2147483647 * 16807 + 7) % 2147483647


#: Ways to draw blocks: how many a sample has, from how many starts, whether the last one is cut to the series' length.
FILLED, WHOLE = "filled", "whole"


def block_samples(returns: DataFrame, r: str, key: str, reps: int, block: int = 20, how: str = FILLED, seed: int = 42) -> DataFrame:
    """(key, rep, m, s, growth): mean, deviation (ddof 0) and compounded value of samples of blocks. `filled`: ceil(n / block)
    blocks from n - block + 1 starts, cut to n rows; `whole`: floor(n / block) blocks from n - block starts, series of up to
    a block being drawn row by row.

    A block is the difference of two rows of the series' running sums, so a sample costs two look-ups a block, not a
    row a draw. Sums are of deviations from the series' mean, which loses no digits. `filled` leaves out
    series shorter than a block."""
    rows = returns.where(F.col(r).isNotNull()).select(key, "date", F.col(r).alias("_r"))
    w, whole = Window.partitionBy(key).orderBy("date"), Window.partitionBy(key)
    upto, factor = w.rowsBetween(Window.unboundedPreceding, 0), 1 + F.col("_r")
    u = F.col("_r") - F.col("_mean")
    sums = rows.withColumns({"_mean": F.avg("_r").over(whole), "_n": F.count(F.lit(1)).over(whole), "_i": F.row_number().over(w).cast("long")})
    sums = sums.select(key, "_n", "_mean", "_i", F.sum(u).over(upto).alias("_p"), F.sum(u * u).over(upto).alias("_q"), F.sum(F.log(F.when(factor != 0, F.abs(factor)).otherwise(1.0))).over(upto).alias("_l"), F.sum((factor < 0).cast("long")).over(upto).alias("_neg"), F.sum((factor == 0).cast("long")).over(upto).alias("_zero"))
    sizes = sums.groupBy(key).agg(F.first("_n").alias("_n"), F.first("_mean").alias("_mean"))
    n = F.col("_n")
    if how == FILLED:
        sizes = sizes.where(n >= block).withColumns({"_size": F.lit(block), "_blocks": F.ceil(n / block), "_starts": n - block + 1})
    else:
        short = n <= block
        sizes = sizes.withColumns({"_size": F.when(short, 1).otherwise(block), "_blocks": F.when(short, n).otherwise(F.floor(n / block)), "_starts": F.when(short, n).otherwise(n - block)})
    draws = sizes.crossJoin(F.broadcast(returns.sparkSession.range(reps).select(F.col("id").alias("rep"))))  # keys x replicates
    draws = draws.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    draws = draws.withColumn("_a", lcg(F.col("rep") * 7919 + F.col("_k") * 104729 + seed) % F.col("_starts"))
    draws = draws.withColumn("_b", F.col("_a") + F.least(F.col("_size"), n - F.col("_k") * F.col("_size")))
    ends, names = draws.select(key, "rep", "_mean", F.explode(F.array(F.struct(F.lit(1).alias("_s"), F.col("_b").alias("_i")), F.struct(F.lit(-1).alias("_s"), F.col("_a").alias("_i")))).alias("x")), ("_p", "_q", "_l", "_neg", "_zero")
    ends = ends.select(key, "rep", "_mean", "x._s", "x._i").join(sums.select(key, "_i", *names), [key, "_i"], "left")  # before the first row: nothing
    g = ends.groupBy(key, "rep", "_mean").agg(F.sum(F.col("_s") * F.col("_i")).alias("_len"), *(F.sum(F.col("_s") * F.coalesce(c, F.lit(0))).alias(c) for c in names))
    off = F.col("_p") / F.col("_len")
    growth = F.when(F.col("_zero") > 0, 0.0).otherwise(F.exp("_l") * F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0))
    return g.select(key, "rep", (F.col("_mean") + off).alias("m"), F.sqrt(F.greatest(F.col("_q") / F.col("_len") - off * off, F.lit(0.0))).alias("s"), growth.alias("growth"), F.col("_len").alias("n"))


def resampled_ics(df: DataFrame, x: str, y: str, key: str, reps: int = 200, least: int = 100, seed: int = 5) -> DataFrame:
    """(key, ic, n, p_value): rank correlation of two columns in each series with `least` rows or more, and the share of resamples whose own
    is as large in size. The rank of a row in a resample follows from how often the rows below it are drawn, so all
    resamples take one sort of the series and sums along it; one series is one group."""
    kind = df.schema[key].dataType.simpleString()

    def ranks(v: np.ndarray, times: np.ndarray) -> np.ndarray:
        order = np.argsort(v, kind="stable")
        new = np.append(True, np.diff(v[order]) != 0)
        tie = np.cumsum(new) - 1
        upto = np.concatenate([np.zeros((len(times), 1)), np.cumsum(times[:, order], 1)], 1)
        edges = np.append(np.flatnonzero(new), len(v))
        low, high = upto[:, edges[:-1]], upto[:, edges[1:]]
        out = np.empty(times.shape)
        out[:, order] = ((low + high + 1) / 2)[:, tie]
        return out

    def correlation(times: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = times.sum(1, keepdims=True)
        a, b = (z - (times * z).sum(1, keepdims=True) / n for z in (a, b))
        va, vb = ((times * z * z).sum(1) for z in (a, b))
        with np.errstate(invalid="ignore", divide="ignore"):
            return (times * a * b).sum(1) / np.sqrt(va * vb)

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        u, v, own = rows.column("_x").to_numpy(), rows.column("_y").to_numpy(), rows.column(key).slice(0, 1)
        n, names = len(u), [key, "ic", "n", "p_value"]
        if n < least:
            return pa.table([own.slice(1), pa.array([], pa.float64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        drawn = lcg_numpy(np.arange(reps)[:, None] * 7919 + np.arange(n) * 104729 + seed) % n
        times = np.bincount((drawn + np.arange(reps)[:, None] * n).ravel(), minlength=reps * n).reshape(reps, n)
        times = np.concatenate([np.ones((1, n), np.int64), times])
        c = correlation(times, ranks(u, times), ranks(v, times))
        p = float((np.rint(np.abs(c[1:]) * (1 << 30)) >= np.rint(abs(c[0]) * (1 << 30))).mean()) if c[0] == c[0] else None
        return pa.table([own, pa.array([c[0]], pa.float64(), from_pandas=True), pa.array([n], pa.int64()), pa.array([p], pa.float64())], names=names)

    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, "date", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return known.groupBy(key).applyInArrow(work, f"{key} {kind}, ic double, n long, p_value double")
