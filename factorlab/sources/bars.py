"""Bars: adapters from transaction tables and files, calendars, dense panels, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount"))])
FIELDS = ("open", "high", "low", "close", "volume", "amount", "vwap")


def with_vwap(bars: DataFrame) -> DataFrame:
    """vwap = amount / volume, null without volume."""
    return bars.withColumn("vwap", F.round(F.try_divide("amount", "volume"), 8))


def weekly(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Weekly bars of suppliers' sales: a tick is a line's price per unit, kept to 8 decimals. Lines are dealt by symbol as they are:
    a bar has about two, which are smaller than one partial bar, and neither bars nor panel are shuffled by symbol again.
    Who reads only the keys of bars has them undealt, since partial keys are smaller than lines."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    if dealt:
        line = line.repartition("l_suppkey")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    tick = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 8)
    bars = line.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(
        F.min_by(tick, order).alias("open"), F.max(tick).alias("high"), F.min(tick).alias("low"), F.max_by(tick, order).alias("close"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount")
    )
    return with_vwap(bars)


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date) of every line: the dates of the weekly bars, repeated, from lines as they are read and not yet dealt by symbol."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))


def weekly_panel(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """panel() of the weekly bars, with some of their fields."""
    return panel(weekly(spark, sf_dir).select("symbol", "date", *fields), weeks(spark, sf_dir))


def panel(bars: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Every symbol on every date of the union calendar; fields are null where a symbol has no bar. A symbol's bars meet the
    calendar as one row, so that only bars are shuffled, by symbol, and later histories need no shuffle of their own.
    dates(date) has all dates of the bars, for callers that know them without the bars."""
    fields = [f for f in bars.schema.fields if f.name not in ("symbol", "date")]
    row, day = F.struct("date", *(f.name for f in fields)), F.struct("date")
    own = bars.groupBy("symbol").agg(F.collect_list(F.when(F.col("symbol").isNotNull() & F.col("date").isNotNull(), row)).alias("_own"))
    calendar = (bars if dates is None else dates).select("date").distinct().agg(F.transform(F.collect_list(day), lambda x: x["date"]).alias("_calendar"))
    empty = lambda d: F.struct(d.alias("date"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    lacking = F.transform(F.array_except("_calendar", F.transform("_own", lambda x: x["date"])), empty)
    return own.crossJoin(F.broadcast(calendar)).select("symbol", F.explode(F.concat("_own", lacking)).alias("_x")).select("symbol", "_x.*").select("symbol", "date", *(f.name for f in fields))


def long_enough(bars: DataFrame, rows: int = 100) -> DataFrame:
    """Bars of symbols with at least so many rows."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("_n") >= rows).drop("_n")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV per symbol, the file name being the six-digit symbol: unreadable numbers become null, rows without a date go."""
    raw = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in ("date", "open", "high", "low", "close", "volume", "amount"))).csv(path)
    raw = raw.withColumn("symbol", F.lpad(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1), 6, "0"))
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c)
    return raw.select("symbol", F.col("date").try_cast("date").alias("date"), *map(number, ("open", "high", "low", "close", "volume", "amount"))).where(F.col("date").isNotNull())


def write(bars: DataFrame, path: str) -> None:
    """Parquet by year, sorted so that date filters prune."""
    bars.withColumn("year", F.year("date")).repartition("year").sortWithinPartitions("date", "symbol").write.mode("overwrite").partitionBy("year").parquet(path)


def stored(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, symbols: list | None = None) -> DataFrame:
    """Bars written by write(): the years of the range prune folders, dates and symbols reach the scan."""
    bars = spark.read.parquet(path)
    for bound, later in ((start, True), (end, False)):
        if bound:
            day, year = F.lit(bound).cast("date"), int(bound[:4])
            bars = bars.where((F.col("date") >= day) & (F.col("year") >= year) if later else (F.col("date") <= day) & (F.col("year") <= year))
    return (bars if symbols is None else bars.where(F.col("symbol").isin(symbols))).drop("year")


def fetched(old: DataFrame, source: DataFrame, wanted: DataFrame, start: str, end: str, max_new: int | None = None) -> DataFrame:
    """The rows of source that the stored bars lack for wanted(symbol) between two dates: whole histories of symbols that
    aren't stored (of these the first max_new by symbol), and what lies before or after the dates that are. A symbol
    whose stored dates reach both ends is left alone. Only symbols with their first and last dates are joined."""
    day = {c: F.lit(v).cast("date") for c, v in (("start", start), ("end", end))}
    seen = summary(old).select("symbol", F.col("first_date").alias("_first"), F.col("last_date").alias("_last"))
    need = wanted.select("symbol").distinct().join(seen, "symbol", "left")
    if max_new is not None:
        new = need.where(F.col("_first").isNull()).orderBy("symbol").limit(max_new)  # a row a symbol
        need = need.where(F.col("_first").isNotNull()).unionByName(new)
    need = need.where(F.col("_first").isNull() | (F.col("_first") > day["start"]) | (F.col("_last") < day["end"]))
    rows = source.where(F.col("date").between(day["start"], day["end"])).join(need, "symbol")
    return rows.where(F.col("_first").isNull() | (F.col("date") < F.col("_first")) | (F.col("date") > F.col("_last"))).select(*source.columns)


def merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """New rows win over old ones of the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def exchange_code(symbol: Column) -> Column:
    """Exchange prefix of a six-digit symbol: Shanghai's begin with 6, all others are Shenzhen's."""
    return F.concat(F.when(F.substring(symbol, 1, 1) == "6", "sh.").otherwise("sz."), symbol)


def keep_last(records: DataFrame, order: str = "seq") -> DataFrame:
    """records(date, symbol, value, order): of repeated cells the last."""
    return records.groupBy("date", "symbol").agg(F.max_by("value", order).alias("value"))


def pivoted(cells: DataFrame, symbols: list) -> DataFrame:
    """A row a date, a column per symbol of a list that the caller bounds."""
    return cells.groupBy("date").pivot("symbol", symbols).agg(F.first("value"))


def unpivoted(wide: DataFrame) -> DataFrame:
    """(date, symbol, value) of a wide table's known cells."""
    return wide.unpivot("date", [c for c in wide.columns if c != "date"], "symbol", "value").where(F.col("value").isNotNull())


def patched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(date, symbol, value), cell by cell: a symbol that `new` has takes its values on all of its dates, unknown
    ones too; other cells stay."""
    dates, symbols = new.select("date").distinct(), new.select("symbol").distinct()
    stays = old.join(dates.withColumn("_d", F.lit(True)), "date", "left").join(symbols.withColumn("_s", F.lit(True)), "symbol", "left").where(F.col("_d").isNull() | F.col("_s").isNull())
    return stays.select("date", "symbol", "value").unionByName(new.where(F.col("value").isNotNull()).select("date", "symbol", "value"))


def listing(bars: DataFrame, last: Column) -> DataFrame:
    """(symbol, listing_date, delist_date) from the bars: the first date; the last one where bars end before `last`."""
    ends = F.max("date")
    return bars.groupBy("symbol").agg(F.min("date").alias("listing_date"), F.when(ends < last, ends).alias("delist_date"))


def special_treatment(panel: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(symbol, date, st): whether the symbol's name marks special treatment; without names none does."""
    if names is None:
        return panel.select("symbol", "date", F.lit(False).alias("st"))
    marked = names.select("symbol", F.contains("name", F.lit("ST")).alias("st"))
    return panel.select("symbol", "date").join(marked, "symbol", "left").withColumn("st", F.coalesce("st", F.lit(False)))


def median_filled(df: DataFrame, column: str) -> DataFrame:
    """Unknown values of a column as the median of its date."""
    middle = F.percentile(column, 0.5).over(Window.partitionBy("date"))
    return df.withColumn(column, F.coalesce(column, middle))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: CTEs of the same bars and panel in DuckDB SQL.
SQL = """
bars AS MATERIALIZED (
  SELECT l_suppkey AS symbol, date_trunc('week', l_shipdate)::DATE AS date,
         first(round(l_extendedprice / l_quantity, 8) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(round(l_extendedprice / l_quantity, 8)) AS high, min(round(l_extendedprice / l_quantity, 8)) AS low,
         last(round(l_extendedprice / l_quantity, 8) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount,
         round(round(sum(l_extendedprice), 2) / nullif(sum(l_quantity), 0), 8) AS vwap
  FROM lineitem GROUP BY 1, 2),
panel AS MATERIALIZED (
  SELECT s.symbol, d.date, open, high, low, close, volume, amount, vwap
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = d.date)
"""
