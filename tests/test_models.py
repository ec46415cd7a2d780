import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.operators import models as M
from factorlab.streaming import ticks as K


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(40):
        for i in range(30):
            a, b = rng.normal(), rng.normal()
            fwd = 0.5 * a - 0.2 * b + rng.normal() * 0.3
            rows.append((i, dt.date(2021, 1, 1) + dt.timedelta(d), float(a), float(b), float(fwd), int(fwd > 0)))
    return spark.createDataFrame(rows, "symbol int, date date, a double, b double, fwd double, label int")


def test_daily_ols(sample):
    got = M.daily_ols(sample, "fwd", ["a", "b"]).toPandas()
    assert len(got) == 40 and abs(got.b_a.mean() - 0.5) < 0.05 and abs(got.b_b.mean() + 0.2) < 0.05


def test_orthogonal_to(sample):
    got = M.orthogonal_to(sample, "fwd", ["a", "b"]).groupBy("date").agg(F.corr("residual", "a").alias("c")).collect()
    assert max(abs(r.c) for r in got) < 1e-9


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("k", [1, 2, 4])
def test_regressions_equal_least_squares(spark, k, intercept):
    rng = np.random.default_rng(k)
    rows = []
    for d in range(6):
        for i in range(25 if d < 5 else 3):  # the last date has fewer rows than unknowns
            x = [float(v) for v in rng.normal(3, 1, 4)]
            if d == 4:
                x[3] = 2 * x[0] - x[1]  # one column follows from others
            rows.append((i, dt.date(2021, 1, 1) + dt.timedelta(d), *(None if rng.random() < 0.05 else v for v in x), float(rng.normal() + x[0])))
    xs = ["p", "q", "r", "s"][:k]
    df = spark.createDataFrame(rows, "symbol int, date date, p double, q double, r double, s double, y double")
    got = {r.date: r for r in M.regressions(df, "y", xs, intercept).collect()}
    rest = {(r.symbol, r.date): r.residual for r in M.orthogonal_to(df, "y", xs, intercept, least=8).collect()}
    for d in sorted(got):
        own = [r for r in df.where(F.col("date") == d).collect() if all(r[x] is not None for x in xs)]
        assert got[d].n == len(own)
        a = np.array([[r[x] for x in xs] + [1.0] * intercept for r in own])
        y = np.array([r.y for r in own])
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        for r, want in zip(own, y - a @ beta, strict=True):
            assert rest[r.symbol, r.date] == (pytest.approx(want, abs=1e-6) if len(own) >= 8 else None)
        if len(own) > k + 1 and not (k == 4 and d == dt.date(2021, 1, 5)):
            assert [got[d][f"x{i}"] for i in range(k)] == pytest.approx(beta[:k], abs=1e-9)
            assert got[d].c == pytest.approx(beta[k] if intercept else 0.0, abs=1e-8)


def test_orthogonal_chain(sample):
    x = sample.withColumn("c", F.col("a") + F.col("b") * 0.5 + F.col("fwd"))
    got = M.orthogonal_chain(x, ["a", "b", "c"]).groupBy("date").agg(*(F.abs(F.sum(F.col(f"o_{p}") * F.col(f"o_{q}"))).alias(p + q) for p, q in ("ab", "ac", "bc"))).collect()
    assert max(max(r.ab, r.ac, r.bc) for r in got) < 1e-9


def test_out_of_fold(sample):
    got = M.out_of_fold(sample, ["a", "b"]).toPandas()
    assert set(got.fold) == {1, 2, 3, 4} or set(got.fold) == {0, 1, 2, 3, 4}
    assert np.corrcoef(got.pred, got.label)[0, 1] > 0.5


def test_permutation(sample):
    got = {r.score: r["drop"] for r in M.permutation_importance(sample, ["a", "b"]).collect()}
    assert got["a"] > 0.1


def lcg(seed):
    return ((seed * 48271 + 69621 + 11) % 2147483647 * 16807 + 7) % 2147483647


def plain_auc(pairs):
    up, down = [p for p, y in pairs if y == 1], [p for p, y in pairs if y == 0]
    return sum((p > q) + (p == q) / 2 for p in up for q in down) / (len(up) * len(down))


def test_dealt_anew(sample):
    rows = sample.select("symbol", "date", "a", "b")
    seed = F.col("symbol").cast("long") * 7919
    got = M.dealt_anew(rows, ["a", "b"], "date", "symbol", seed).collect()
    assert len(got) == 1200
    by_day = {}
    for r in got:
        by_day.setdefault(r.date, []).append(r)
    for day in by_day.values():
        day.sort(key=lambda r: r.symbol)
        for k, v in enumerate("ab"):
            order = sorted(day, key=lambda r: (lcg(r.symbol * 7919 + k), r.symbol))
            assert [r[f"moved_{v}"] for r in day] == [r[v] for r in order]


def test_regime_importance(sample):
    epoch = dt.date(1970, 1, 1)
    vol = {d: (None if d == 39 else float((d * 7) % 13)) for d in range(40)}
    market = sample.sparkSession.createDataFrame([(dt.date(2021, 1, 1) + dt.timedelta(d), v, None if d % 5 == 0 else float(d)) for d, v in vol.items()], "date date, vol double, turn double")
    got = {(r.regime, r.feature): r for r in M.regime_importance(sample.join(market, "date"), ["a", "b"], ["vol", "turn"]).collect()}
    rows = [r.asDict() for r in sample.join(market, "date").where("vol IS NOT NULL").collect()]
    days = sorted({r["date"] for r in rows})
    on = {d: sorted((r for r in rows if r["date"] == d), key=lambda r: r["symbol"]) for d in days}
    for d in days:
        for s in "ab":
            x = np.array([r[s] for r in on[d]])
            for r, z in zip(on[d], (x - x.mean()) / (x.std(ddof=1) + 1e-12), strict=True):
                r["z" + s] = z
    v = {d: on[d][0]["vol"] for d in days}
    rank = {d: 30 * sum(v[x] < v[d] for x in days) + (30 * sum(v[x] == v[d] for x in days) + 1) / 2 for d in days}
    regime = {d: int(rank[d] > (min(rank.values()) + max(rank.values())) / 2) for d in days}
    m = {}
    for c in ("vol", "turn"):
        x = [on[d][0][c] for d in days]
        known = np.array([k for k in x if k is not None])
        m[c] = {d: 0.0 if k is None else (k - known.mean()) / (known.std(ddof=1) + 1e-12) for d, k in zip(days, x, strict=True)}
    base_seed = lambda d: (d - epoch).days * 104729 + 11
    for g in (0, 1):
        mine = [d for d in days if regime[d] == g]
        moved = {}
        for k, c in enumerate(("vol", "turn")):
            order = sorted(mine, key=lambda d: (lcg(base_seed(d) + 2 + k), d))
            moved[c] = {d: m[c][o] for d, o in zip(mine, order, strict=True)}
        for feature in ("", "a", "b", "vol", "turn"):
            pairs = []
            for d in mine:
                dealt = {s: [r["z" + s] for r in (sorted(on[d], key=lambda r: (lcg(r["symbol"] * 7919 + base_seed(d) + k), r["symbol"])) if feature == s else on[d])] for k, s in enumerate("ab")}
                shift = sum((moved if feature == c else m)[c][d] for c in ("vol", "turn"))
                pairs += [(round((dealt["a"][i] + dealt["b"][i] + shift) * 2**30), r["label"]) for i, r in enumerate(on[d])]
            want = plain_auc(pairs)
            if feature:
                assert got[g, feature].auc_permuted == pytest.approx(want, abs=1e-6) and got[g, feature].n == len(pairs)
            else:
                assert {round(r.auc - want, 6) for (k, _), r in got.items() if k == g} == {0.0}
    assert len(got) == 8


def test_stream(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 10), 10.0, 1.0), ("a", dt.datetime(2024, 1, 3), 12.0, 2.0), ("a", dt.datetime(2024, 1, 9), 9.0, 1.0), ("b", dt.datetime(2024, 1, 2), 5.0, 4.0)]
    schema = "symbol string, ts timestamp, price double, volume double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = K.windowed(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").foreachBatch(K.upsert(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.symbol, str(r.date)): r for r in K.current(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {("a", "2024-01-01"), ("a", "2024-01-08"), ("b", "2024-01-01")}
    r = got["a", "2024-01-01"]
    assert (r.open, r.high, r.low, r.close, r.volume, r.amount) == (10, 12, 10, 12, 3, 34)
