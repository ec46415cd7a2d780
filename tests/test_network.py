"""The network: its gradients against differences, training that repeats, held-out accuracy, edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.operators import boosting as B
from factorlab.operators import network as N

SMALL = N.Params(layers=(16, 8), epochs=40, patience=15, batch=200, rate=0.01, dropout=0.1, tasks=2)


def test_gradients():
    rng = np.random.default_rng(1)
    p = N.Params(layers=(5, 4))
    w, _ = N.started(3, p, 0)
    w["g0"], w["s1"] = rng.uniform(0.5, 1.5, 5), rng.normal(size=4)
    x, y = rng.normal(size=(12, 3)), rng.integers(0, 2, 12)
    keep = [(rng.random((12, k)) > 0.3) / 0.7 for k in p.layers]
    _, grad, _ = N.backward(w, x, y, 1.7, keep)
    for k in w:
        for at in np.ndindex(w[k].shape):
            was, loss = w[k][at], []
            for step in (1e-6, -1e-6):
                w[k][at] = was + step
                loss.append(N.backward(w, x, y, 1.7, keep)[0])
            w[k][at] = was
            assert grad[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=2e-5)


def test_running_statistics_give_the_batch_result():
    rng = np.random.default_rng(2)
    p = N.Params(layers=(4,))
    w, run = N.started(2, p, 0)
    x = rng.normal(size=(50, 2))
    _, _, seen = N.backward(w, x, np.zeros(50), 1.0, [np.ones((50, 4))])
    z = x @ w["w0"] + w["b0"]
    assert seen["m0"] == pytest.approx(z.mean(0)) and seen["v0"] == pytest.approx(z.var(0, ddof=1))
    run |= {"m0": z.mean(0), "v0": z.var(0)}
    hat = np.maximum((z - z.mean(0)) / np.sqrt(z.var(0) + 1e-5), 0)
    assert N.forward(w, run, x) == pytest.approx((hat @ w["w1"] + w["b1"])[:, 0])


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(60):
        for i in range(30):
            a, b = rng.normal(), rng.normal()
            up = (a > 0) != (b > 0)
            rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(d), None if rng.random() < 0.05 else a, b, None if rng.random() < 0.1 else int(rng.random() < (0.9 if up else 0.1))))
    return B.with_folds(spark.createDataFrame(rows, "symbol int, date date, a double, b double, label int").repartition(3), 3, 2).persist()


@pytest.fixture(scope="module")
def fit(sample):
    model, scale = N.train(sample, ["a", "b"], ["symbol", "date"], params=SMALL)
    return model.persist(), scale


def curves(model):
    return {r.fold: r.value for r in model.where("name = 'auc'").collect()}


def test_it_learns_what_no_line_can(sample, fit):
    model, scale = fit
    best = {f: max(c) for f, c in curves(model).items()}
    assert set(best) == {0, 1, 2} and best[2] > 0.8
    p = N.scored(sample.where("valid = 2"), model, scale, ["a", "b"], ["symbol", "date"], F.col("valid"))
    rows = p.join(sample, ["symbol", "date"]).where("label IS NOT NULL").collect()
    up, down = [r.p for r in rows if r.label == 1], [r.p for r in rows if r.label == 0]
    auc = sum((x > y) + (x == y) / 2 for x in up for y in down) / (len(up) * len(down))
    assert auc == pytest.approx(best[2], abs=1e-3)  # the stored network is the one of the best epoch


def test_it_stops_early_and_repeats(sample, fit):
    model, _ = fit
    again, _ = N.train(sample.repartition(5), ["a", "b"], ["symbol", "date"], params=SMALL)
    assert curves(again) == curves(model)
    for r in model.where("name = 'auc'").collect():
        assert r.epoch == int(np.argmax(r.value)) + 1 and len(r.value) == min(SMALL.epochs, r.epoch + SMALL.patience)


def test_edges(spark):
    schema = "symbol int, date date, a double, label int, train int, valid int"
    day = dt.date(2020, 1, 1)
    for rows in ([], [(1, day, 1.0, None, 1, 0)], [(i, day, 1.0, 1, 1, None) for i in range(9)]):
        model, scale = N.train(spark.createDataFrame(rows, schema), ["a"], ["symbol", "date"], params=SMALL)
        assert model.count() == 0
        assert N.scored(spark.createDataFrame(rows, schema), model, scale, ["a"], ["symbol", "date"]).collect() == []
