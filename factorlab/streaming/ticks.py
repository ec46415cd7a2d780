"""Weekly bars from a stream of ticks: event-time windows with a watermark, written by batch as an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import bars as B


def windowed(ticks: DataFrame, late: str = "7 days", width: str = "7 days") -> DataFrame:
    """ticks(symbol, ts, price, volume): bars of each window; ticks later than the watermark are left out. Windows
    start on Mondays, as weekly bars do. Ties of time go by price and volume."""
    order = F.struct("ts", "price", "volume")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, startTime="4 days").alias("w"))
    bars = g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount"))
    return bars.select("symbol", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume", "amount")


def upsert(path: str):
    """For foreachBatch: a batch's bars replace those of the same symbol and date; batches are numbered folders, so a
    batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark, path: str) -> DataFrame:
    """The latest version of each bar."""
    all_ = spark.read.parquet(path)
    return all_.groupBy("symbol", "date").agg(F.max_by(F.struct(*(c for c in B.FIELDS if c != "vwap")), "batch").alias("x")).select("symbol", "date", "x.*")
