"""Turns factor expressions into staged columns.

Every window node becomes one column, however many factors use it. Nodes whose inputs are ready are added
together: first all that need a symbol's history, then all that need a date's cross-section, so that a set
of factors needs as few exchanges as its deepest factor (symbol, date, symbol).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import SCALAR, SECTION, Expr

KEYS = ("symbol", "date")
#: Steps per unit to which logarithms, correlations and slopes are kept, so that equal ones tie on any engine.
STEPS = float(1 << 30)
#: Window columns that one stage adds at most: bounds the size of generated code.
STAGE = 48
#: Ranks of one stage from which on they are taken in one grouped map per date: as windows each needs a sort of its own.
GROUPED = 12


def nodes(roots: Iterable[Expr]) -> list[Expr]:
    """All different nodes, arguments first."""
    seen: dict[Expr, None] = {}

    def visit(x: Expr) -> None:
        if x not in seen:
            for a in x.args:
                visit(a)
            seen[x] = None

    for r in roots:
        visit(r)
    return list(seen)


def stepped(c: Column) -> Column:
    return F.rint(c * STEPS) / STEPS


class Plan:
    def __init__(self, roots: dict[str, Expr]):
        self.roots = roots
        self.windows = [x for x in nodes(roots.values()) if x.kind != SCALAR]
        self.names = {x: f"_{x.op}{i}" for i, x in enumerate(self.windows)}

    def stages(self) -> list[tuple[str, list[Expr]]]:
        """(kind, nodes) in order; sma nodes are a kind of their own."""
        kind = lambda x: "sma" if x.op == "sma" else x.kind
        ready: set[Expr] = set()
        left, out = list(self.windows), []
        needs = {x: [y for y in nodes(x.args) if y.kind != SCALAR] for x in left}
        while left:
            can = [x for x in left if all(y in ready for y in needs[x])]
            now = min({kind(x) for x in can}, key=("series", "sma", SECTION).index)
            batch = [x for x in can if kind(x) == now][:STAGE]
            out.append((now, batch))
            ready |= set(batch)
            left = [x for x in left if x not in ready]
        return out

    def column(self, x: Expr) -> Column:
        """The value of a node over columns that are there."""
        if x in self.names:
            return F.col(self.names[x])
        a = [self.column(y) for y in x.args]
        infinite = any(y.may_be_infinite for y in x.args)
        known = lambda c: F.when(~F.isnan(c), c) if infinite else c
        match x.op:
            case "field":
                return F.col(x.params[0])
            case "const":
                return F.lit(x.params[0]).cast("double")
            case "add":
                return known(a[0] + a[1])
            case "sub":
                return known(a[0] - a[1])
            case "mul":
                return known(a[0] * a[1])
            case "div":
                zero = F.when(a[0] > 0, F.lit(float("inf"))).when(a[0] < 0, F.lit(float("-inf")))
                return F.when(a[1] == 0, zero).otherwise(known(F.try_divide(a[0], a[1])))
            case "neg":
                return -a[0]
            case "abs":
                return F.abs(a[0])
            case "sign":
                return F.signum(a[0])
            case "sqrt":
                return F.when(a[0] >= 0, F.sqrt(a[0]))
            case "log":
                return F.when(a[0] > 0, stepped(F.log(a[0]))).when(a[0] == 0, F.lit(float("-inf")))
            case "lt":
                return F.coalesce(a[0] < a[1], F.lit(False))
            case "le":
                return F.coalesce(a[0] <= a[1], F.lit(False))
            case "eq":
                return F.coalesce(a[0] == a[1], F.lit(False))
            case "and":
                return a[0] & a[1]
            case "known":
                return a[0].isNotNull()
            case "finite":
                return F.when(F.abs(a[0]) < float("inf"), a[0])
            case "where":
                return F.when(a[0], a[1]).otherwise(a[2])
            case "emax" | "emin":
                return F.when(a[0].isNotNull() & a[1].isNotNull(), (F.greatest if x.op == "emax" else F.least)(*a))
            case "fmax":
                return F.greatest(*a)
            case "fmin":
                return F.least(*a)
        raise ValueError(x.op)

    def window(self, x: Expr) -> Column:
        """A window node over its arguments' columns."""
        a = [self.column(y) for y in x.args]
        history = Window.partitionBy("symbol").orderBy("date")
        if x.op == "lag":
            return F.lag(a[0], x.params[0]).over(history)
        if x.op == "clip":
            whole = Window.partitionBy("symbol")
            mean, dev = F.avg(a[0]).over(whole), F.stddev_samp(a[0]).over(whole)
            return F.when(a[0].isNotNull() & (dev > 0), F.least(F.greatest(a[0], mean - 10 * dev), mean + 10 * dev)).otherwise(a[0])
        if x.op == "rank":
            ordered = Window.partitionBy("date").orderBy(a[0].asc_nulls_last())
            upto = F.count(a[0]).over(ordered.rangeBetween(Window.unboundedPreceding, 0))
            return F.when(a[0].isNotNull(), (F.rank().over(ordered) + upto) / 2.0 / F.count(a[0]).over(Window.partitionBy("date")))
        n = x.params[0]
        frame = history.rowsBetween(-(n - 1), 0)
        if x.op == "count":
            return F.when(F.count(F.lit(1)).over(frame) == n, F.sum(a[0].cast("double")).over(frame))
        a = [F.when(F.abs(c) < float("inf"), c) if y.may_be_infinite else c for c, y in zip(a, x.args, strict=True)]
        if x.op == "tsrank":
            no_larger = sum((F.when(F.lag(a[0], k).over(history) <= a[0], 1.0).otherwise(0.0) for k in range(n)), F.lit(0.0))
            return F.when(F.count(a[0]).over(frame) == n, no_larger / n)
        if x.op in ("corr", "beta"):
            u, v = (F.when(a[0].isNotNull() & a[1].isNotNull(), c) for c in a)
            moves = (F.count(u).over(frame) == n) & (F.min(v).over(frame) < F.max(v).over(frame))
            if x.op == "beta":
                return F.when(moves, stepped(F.covar_samp(u, v).over(frame) / F.var_pop(v).over(frame)))
            moves &= F.min(u).over(frame) < F.max(u).over(frame)
            return F.when(moves, stepped(F.covar_pop(u, v).over(frame) / (F.stddev_pop(u).over(frame) * F.stddev_pop(v).over(frame))))
        value = {"sum": F.sum, "std": F.stddev_pop, "max": F.max, "min": F.min}[x.op](a[0]).over(frame)
        return F.when(F.count(a[0]).over(frame) == n, value)

    def smoothed(self, df: DataFrame, batch: list[Expr]) -> DataFrame:
        """Recursive means, a symbol at a time: the recursion has no window form of bounded work."""
        df, keep, schema = self.with_inputs(df, batch)
        todo = [(f"_in{i}", self.names[x], *x.params) for i, x in enumerate(batch)]

        def work(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("date")
            done = [pa.array(recursive_mean(pd.Series(rows.column(source).to_numpy()), n, m), pa.float64(), from_pandas=True) for source, _, n, m in todo]
            return pa.table([rows.column(c) for c in keep] + done, names=schema.names)

        return df.groupBy("symbol").applyInArrow(work, schema)

    def with_inputs(self, df: DataFrame, batch: list[Expr]) -> tuple[DataFrame, list[str], T.StructType]:
        """df with _in0, _in1, ..., the batch's first arguments; its own columns; these and the batch's as a schema."""
        keep = df.columns
        df = df.withColumns({f"_in{i}": self.column(x.args[0]).cast("double") for i, x in enumerate(batch)})
        return df, keep, T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField(self.names[x], T.DoubleType()) for x in batch])

    def ranked(self, df: DataFrame, batch: list[Expr]) -> DataFrame:
        """Ranks of many columns within each date, in one grouped map over the dates."""
        df, keep, schema = self.with_inputs(df, batch)

        def work(rows: pa.Table) -> pa.Table:
            return pa.table([rows.column(c) for c in keep] + [shares(rows.column(f"_in{i}")) for i in range(len(batch))], names=schema.names)

        return df.groupBy("date").applyInArrow(work, schema)

    def uses(self, x: Expr) -> set[str]:
        """The columns that the column of a node reads."""
        if x in self.names:
            return {self.names[x]}
        return {x.params[0]} if x.op == "field" else set().union(*map(self.uses, x.args))

    def apply(self, bars: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """symbol, date, the columns to keep and one column per root."""
        df, stages = bars, self.stages()
        for i, (kind, batch) in enumerate(stages):
            if kind == "sma" or (kind == SECTION and len(batch) >= GROUPED):
                # only what this stage and later ones read goes through Python
                readers = [*self.roots.values(), *(a for _, later in stages[i:] for x in later for a in x.args)]
                read = {*KEYS, *keep}.union(*map(self.uses, readers))
                df = df.select(*(c for c in df.columns if c in read))
                df = self.smoothed(df, batch) if kind == "sma" else self.ranked(df, batch)
            else:
                df = df.select("*", *(self.window(x).alias(self.names[x]) for x in batch))
        return df.select(*KEYS, *keep, *(self.column(x).cast("double").alias(name) for name, x in self.roots.items()))


def shares(values: pa.ChunkedArray) -> pa.Array:
    """Ranks from the smallest, ties by their mean, over the number of known values; unknown ones stay so."""
    x = values.to_numpy()
    known = ~np.asarray(values.is_null().combine_chunks(), bool)
    out = np.zeros(len(x))
    _, which, count = np.unique(x[known], return_inverse=True, return_counts=True)
    upto = np.cumsum(count)
    out[known] = ((upto - count + 1 + upto) / 2.0 / max(int(known.sum()), 1))[which]
    return pa.array(out, mask=~known)


def recursive_mean(x: pd.Series, n: int, m: int) -> pd.Series:
    """SMA of one ordered series: null before row n, the mean of the first n there, then the recursion from the
    first known value; unknown values are skipped and the last result carried."""
    x = x.astype(float)
    out = pd.Series(float("nan"), index=x.index)
    if len(x) >= n:
        out.iloc[n:] = x.ewm(alpha=m / n, adjust=False, ignore_na=True).mean().iloc[n:]
        out.iloc[n - 1] = x.iloc[:n].mean()
    return out
