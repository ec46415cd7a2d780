"""Yearly choice of factors against plain versions, and that nothing of a year or after it reaches its choice."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlab import model_queries as MQ
from factorlab import research_queries as RQ
from factorlab.functions.alphas import PANEL, SPARSE, definitions
from factorlab.operators import screening as SC
from factorlab.operators import universe as U
from factorlab.plans.planner import Plan
from factorlab.sources.scratch import Written

NAMES = ["alpha001", "alpha055", *(f"f{i}" for i in range(12))]


def made(seed=4, change_from=None):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(230):
        date = dt.date(2000, 1, 3) + dt.timedelta(7 * k)
        common = rng.normal(size=3) * 0.1
        for i, f in enumerate(NAMES):
            ic, slope, full = common[i % 3] + 0.03 * (i % 4) + rng.normal() * 0.05, 0.01 * (i % 4) + rng.normal() * 0.03, float(rng.random() < 0.8)
            if change_from and date >= change_from:
                ic, slope, full = -1.0, 5.0, 0.0
            rows.append((f, date, None if (i == 5 and k < 90) or rng.random() < 0.02 else float(ic), None if rng.random() < 0.02 else float(slope), None if rng.random() < 0.02 else full))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SC.DAILY).repartition(3)


def plain(rows):
    t = pd.DataFrame(rows, columns=["factor", "date", "ic", "slope", "full"])
    dates = sorted(t.date.unique())
    known = {d: later.year for d, later in zip(dates, dates[1:], strict=False)}
    gates, pools = {}, {}
    for year in sorted({d.year for d in dates})[2:]:
        past = t[t.date.map(lambda d: known.get(d, 9999) < year)]
        for f, x in past.groupby("factor"):
            ic, slope = x.ic.dropna().to_numpy(float), x.slope.dropna().to_numpy(float)
            ir, fm, cs = ic.mean() / ic.std(), slope.mean() / slope.std() * np.sqrt(len(slope)), x["full"].dropna().mean()
            gates[year, f] = (ir, fm, cs, abs(ir) > 0.05 and abs(fm) > 2 and cs > 0.5)
        passing = [f for f in NAMES if gates[year, f][3]]
        if len(passing) < 3:
            continue
        wide = past[past.factor.isin([*passing, "alpha001", "alpha055"])].pivot(index="date", columns="factor", values="ic").astype(float).dropna()
        corr = wide.corr().abs()
        order = ["alpha001", "alpha055", *sorted((f for f in passing if f not in SC.MUST_KEEP), key=lambda f: (-abs(gates[year, f][0]), f))]
        kept = []
        for f in order:
            if f in SC.MUST_KEEP or all(corr.loc[f, k] <= 0.8 for k in kept):
                kept.append(f)
        best = sorted(kept, key=lambda f: (-abs(gates[year, f][0]), f))[: SC.POOL]
        pools[year] = best + [f for f in SC.MUST_KEEP if f not in best]
    return gates, pools


def results(spark, rows):
    daily = frame(spark, rows)
    gated = SC.yearly_gates(daily)
    gates = {(r.test_year, r.factor): (r.ic_ir, r.fm_t, r.cs_effective_ratio, r.passed) for r in gated.collect()}
    pools = {}
    for r in sorted(SC.yearly_pools(daily, gated).collect(), key=lambda r: (r.test_year, r.place)):
        pools.setdefault(r.test_year, []).append(r.factor)
    return gates, pools


def test_gates_and_pools_equal_plain_ones(spark):
    rows = made()
    gates, pools = results(spark, rows)
    want_gates, want_pools = plain(rows)
    assert gates.keys() == want_gates.keys() and len({y for y, _ in gates}) == 3
    for k, v in gates.items():
        assert v[:3] == pytest.approx(want_gates[k][:3], rel=1e-9) and v[3] == want_gates[k][3]
    assert pools == want_pools and pools


def test_later_years_do_not_reach_back(spark):
    """From 2003 on everything differs: the choice for 2003 (known before it) and for 2002 stays as it was."""
    gates, pools = results(spark, made())
    other_gates, other_pools = results(spark, made(change_from=dt.date(2003, 1, 1)))
    for year in (2002, 2003):
        for k in (k for k in gates if k[0] == year):  # sums differ in their last bits
            assert gates[k] == pytest.approx(other_gates[k], rel=1e-9)
        assert pools.get(year) == other_pools.get(year)
    assert {k: v for k, v in gates.items() if k[0] == 2004} != {k: v for k, v in other_gates.items() if k[0] == 2004}


def test_the_last_return_of_a_year_belongs_to_the_next(spark):
    dates = spark.createDataFrame([(dt.date(2001, 12, 24),), (dt.date(2001, 12, 31),), (dt.date(2002, 1, 7),)], "date date")
    assert sorted(map(tuple, SC.known_years(dates).collect())) == [(dt.date(2001, 12, 24), 2001), (dt.date(2001, 12, 31), 2002)]
    assert SC.known_years(dates, 2).collect()[0].known == 2002


def test_members_values_equal_the_planners(spark):
    """What is told of members, with metrics and without, is what the planner gives: series, ranks of series and series of ranks."""
    names = ["alpha014", "alpha018", "alpha055", "alpha001", "alpha094", "alpha150", "alpha042"]
    panel, places = MQ.placed_panel(spark, "/root/testdata/sf0.001")
    of = {c: {f: definitions()[f].expr for f in names if definitions()[f].calendar == c} for c in (PANEL, SPARSE)}
    assert all(of.values())
    want = Plan(of[PANEL]).apply(panel).join(Plan(of[SPARSE]).apply(panel.where("close IS NOT NULL")), ["symbol", "date"], "left")
    given = panel.withColumn("place", F.when(F.col("symbol") % 3 == 0, F.col("symbol").cast("double"))).withColumn("ever", F.col("symbol") % 3 == 0)
    want = {(r.date, r.symbol): tuple(r[f] for f in names) for r in want.where("symbol % 3 = 0").collect()}
    for judged in (False, True):
        got = SC.member_values(SC.evaluated(Written(given).df, names, judged), names).collect()
        assert {(r.date, r.place): tuple(r[f] for f in names) for r in got} == {k: tuple(v if v is None or abs(v) < float("inf") else None for v in x) for k, x in want.items()}


def test_the_panel_is_written_once_and_factors_take_one_table(spark, monkeypatch):
    """Bars aren't written and shuffled again before their panel; the values of all factors come from one shuffle of the panel."""
    written, plans, write = [], [], Written
    monkeypatch.setattr(RQ, "Written", lambda df: (written.append(df.columns), write(df))[1])
    panel, _ = MQ.placed_panel(spark, "/root/testdata/sf0.001")
    assert len(written) == 2 and written[1] == ["symbol", "date", "place"]
    monkeypatch.setattr(SC, "Written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    SC.evaluated(panel, ["alpha001", "alpha014", "alpha055"])
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 3  # by symbol, by slice, and the few symbols with a place


def test_members_are_those_of_the_universe(spark):
    panel, _ = MQ.placed_panel(spark, "/root/testdata/sf0.01")
    u = U.liquid(panel, RQ.TOP, 20, 52)
    wrong = u.where("member <> (place IS NOT NULL) OR (member AND NOT ever)").count()
    assert wrong == 0 and u.where("member").count() > 1000
