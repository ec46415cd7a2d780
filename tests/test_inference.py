"""Block samples from running sums and resampled rank correlations against plain versions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from factorlab.operators import statistics as S


def lcg(seed):
    return ((seed * 48271 + 69621 + 11) % 2147483647 * 16807 + 7) % 2147483647


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    data = {"long": rng.normal(0.001, 0.02, 93), "even": rng.normal(0, 0.5, 60) - 0.2, "short": rng.normal(0, 0.01, 7), "lost": np.append(rng.normal(0, 0.1, 30), -1.0), "flat": np.full(25, 0.01)}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(i), float(r)) for k, v in data.items() for i, r in enumerate(v)] + [("long", dt.date(2019, 1, 1), None), ("none", dt.date(2019, 1, 1), None)]
    return spark.createDataFrame(rows, "factor string, date date, r double").repartition(4), data


@pytest.mark.parametrize("how", [S.FILLED, S.WHOLE])
def test_block_samples(series, how):
    df, data = series
    got = {(r["factor"], r.rep): r for r in S.block_samples(df, "r", "factor", 40, 10, how).collect()}
    want = {}
    for k, x in data.items():
        n = len(x)
        if how == S.FILLED and n < 10:
            continue
        size = 1 if how == S.WHOLE and n <= 10 else 10
        blocks, starts = (math.ceil(n / 10), n - 9) if how == S.FILLED else (n if size == 1 else n // 10, n if size == 1 else n - 10)
        for rep in range(40):
            sample = np.concatenate([x[s : s + size] for s in (lcg(rep * 7919 + b * 104729 + 42) % starts for b in range(blocks))])
            want[k, rep] = sample[:n] if how == S.FILLED else sample
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert got[k].n == len(x) and got[k].m == pytest.approx(x.mean(), abs=1e-12) and got[k].s == pytest.approx(x.std(), abs=1e-7)
        assert got[k].growth == pytest.approx(np.prod(1 + x), rel=1e-9, abs=1e-12)


def test_resampled_ics(spark):
    rng = np.random.default_rng(9)
    rows, data = [], {}
    for k, n in (("a", 120), ("b", 150), ("tied", 130), ("const", 110), ("few", 99)):
        x = rng.normal(size=n)
        y = x * (1.0 if k == "a" else 0.0) + rng.normal(size=n)
        if k == "tied":
            x, y = np.round(x), np.round(y)
        if k == "const":
            x = np.ones(n)
        data[k] = x, y
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(i), float(p), float(q)) for i, (p, q) in enumerate(zip(x, y, strict=True))]
        rows.append((k, dt.date(2019, 1, 1), None, 1.0))
    df = spark.createDataFrame(rows, "symbol string, date date, x double, y double").repartition(3)
    got = {r.symbol: r for r in S.resampled_ics(df, "x", "y", "symbol", reps=60).collect()}
    assert set(got) == {"a", "b", "tied", "const"} and got["const"].ic is None and got["const"].p_value is None
    spearman = lambda p, q: pd.Series(p).rank().corr(pd.Series(q).rank())
    for k in ("a", "b", "tied"):
        x, y = data[k]
        n = len(x)
        assert got[k].n == n and got[k].ic == pytest.approx(spearman(x, y), abs=1e-12)
        boot = []
        for rep in range(60):
            at = [lcg(rep * 7919 + i * 104729 + 5) % n for i in range(n)]
            boot.append(spearman(x[at], y[at]))
        assert got[k].p_value == pytest.approx(np.mean(np.abs(boot) >= abs(got[k].ic) - 1e-9), abs=1e-12)


def test_iid_bootstrap_multiplies_no_rows(spark):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if i == 3 else math.sin(k * 31 + i * i)) for k in (1, 2, 7) for i in range(5 + 6 * k)]
    b = S.iid_bootstrap(spark.createDataFrame(rows, "symbol long, date date, ret double"), "ret", 50)
    assert "Generate" not in b._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.symbol, r.rep): r.m for r in b.collect()}
    assert len(got) == 150
    for k in (1, 2, 7):
        x = [r for s, _, r in rows if s == k and r is not None]
        for rep in range(50):
            places = [((rep * 7919 + i * 104729 + k * 15485863 + 7) * 48271 + 69621 + 11) % 2147483647 for i in range(len(x))]
            assert got[k, rep] == pytest.approx(sum(x[(p * 16807 + 7) % 2147483647 % len(x)] for p in places) / len(x), abs=1e-12)


@pytest.mark.parametrize("name", ["ic_corr", "signal_similarity", "bootstrap_sign"])
def test_shared_panels_are_computed_once(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan  # what is read twice is a written table, not the sales again


def test_residual_momentum_sums_each_window_by_itself(spark):
    rng = np.random.default_rng(5)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(int(k))
    r = {1: rng.normal(0, 0.1, 40), 2: rng.normal(0, 0.1, 40), 3: np.full(40, 0.5)}
    r[1][3] = 1e9  # a value that has left the window leaves nothing behind
    rows = [(s, day(k), None if s == 2 and k % 7 == 0 else float(v)) for s, x in r.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol int, date date, ret double").repartition(3)
    plan = S.residual_momentum(df, 12, 5, 6)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Window") < 3  # before: a moving frame of Spark's for every sum
    got = {(x.symbol, x.date): x.momentum for x in plan.collect()}
    r[2][::7] = 0.0
    m = np.mean([r[1], r[2], r[3]], 0)
    for s, x in r.items():
        e = []
        for k in range(40):
            w = slice(max(0, k - 11), k + 1)
            e.append(x[k] - np.cov(x[w], m[w])[0, 1] / np.var(m[w], ddof=1) * m[k] if k >= 5 else None)
            part = [v for v in e[-5:] if v is not None]
            want = sum(part) if len(part) >= 5 else None
            assert got[s, day(k)] == (want if want is None else pytest.approx(want, rel=1e-6, abs=1e-9)), (s, k)
