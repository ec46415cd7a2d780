"""Queries of the factor library: every operator and factor, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphas import PANEL, Factor, definitions, operators
from .plans.oracle import factor_ctes, rounded
from .plans.planner import Plan
from .sources import bars as B


def kept(c: Column) -> Column:
    """What the queries keep of a value: a binary grid by magnitude, which rounds alike on any engine."""
    grid = lambda k: F.rint(c * float(1 << k)) / float(1 << k)
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(c))) - 30)
    return F.when(F.abs(c) < 10, grid(27)).when(F.abs(c) < 1e5, grid(14)).otherwise(F.rint(c / unit) * unit) + 0.0


def compute(bars: DataFrame, factors: list[Factor], dates: DataFrame | None = None) -> DataFrame:
    """symbol, date and a column per factor, all of one calendar."""
    source = B.panel(bars, dates) if factors[0].calendar == PANEL else bars
    return Plan({f.name: f.expr for f in factors}).apply(source)


def query(factor: Factor) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compute(B.weekly(spark, sf_dir), [factor], B.weeks(spark, sf_dir)).select("symbol", F.col("date").cast("string").alias("date"), kept(F.col(factor.name)).alias("value"))

    return run


def sql(factor: Factor) -> str:
    source = "panel" if factor.calendar == PANEL else "bars"
    return f"WITH {B.SQL}, {factor_ctes({'value': factor.expr}, source)} SELECT symbol, date::VARCHAR AS date, {rounded('value')} AS value FROM factors"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: query(f) for k, f in (operators() | definitions()).items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql(f) for k, f in (operators() | definitions()).items()}
