"""Boosted trees over partitions against a plain version on one machine, which grows best first, leaf by leaf."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.operators import boosting as B

FEATURES = ["a", "b", "c"]
SMALL = B.Params(rounds=12, patience=4, rate=0.3, depth=4, leaves=6, least_rows=8, row_share=0.7, feature_share=0.6, bins=16)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(60):
        for i in range(25):
            a, b, c = rng.normal(), round(rng.normal(), 1), rng.normal()
            up = (a > 0) != (b > 0.3)
            label = None if rng.random() < 0.2 else int(rng.random() < (0.8 if up else 0.25))
            rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(d), None if rng.random() < 0.1 else a, b, None if d < 5 else c, label))
    df = spark.createDataFrame(rows, "symbol int, date date, a double, b double, c double, label int").repartition(5)
    return B.with_folds(df, 3, 2).withColumn("id", F.xxhash64("symbol", "date")).persist()


def plain(rows, cuts, fold, p):
    """Trees of one fold as nested nodes, and the held-out AUC after each round."""
    use = [r for r in rows if r.label is not None]
    own, held = [r for r in use if r.train >> fold & 1], [r for r in use if r.valid == fold]
    n_of = {y: sum(r.label == y for r in own) for y in (0, 1)}
    weight = {y: len(own) / (2 * n_of[y]) for y in (0, 1)}
    bin_of = lambda r, c: None if r[FEATURES[c]] is None else int(np.searchsorted(cuts[c], r[FEATURES[c]], "left"))
    bins = {r.id: [bin_of(r, c) for c in range(len(FEATURES))] for r in use}
    raw = {r.id: 0.0 for r in use}
    sums = lambda s: (sum(x[1] for x in s) / B.STEPS, sum(x[2] for x in s) / B.STEPS)

    def best_split(node, columns, depth):
        g, h = sums(node)
        out = (1e-9, None)
        if depth == p.depth or len(node) < 2 * p.least_rows:
            return out
        for c in columns:
            lost = any(bins[x[0]][c] is None for x in node)
            for way in (False, True) if lost else (None,):
                for j in range(len(cuts[c])):
                    left = [x for x in node if (bool(way) if bins[x[0]][c] is None else bins[x[0]][c] <= j)]
                    gl, hl = sums(left)
                    if min(len(left), len(node) - len(left)) < p.least_rows or hl < 1e-3 or h - hl < 1e-3:
                        continue
                    gain = gl**2 / (hl + p.ridge) + (g - gl) ** 2 / (h - hl + p.ridge) - g**2 / (h + p.ridge)
                    if gain > out[0]:
                        out = (gain, (int(c), j, 2 * len(left) > len(node) if way is None else way))
        return out

    def goes_left(i, split):
        b = bins[i][split[0]]
        return split[2] if b is None else b <= split[1]

    trees, curve = [], []
    for round_ in range(p.rounds):
        seen = B.sampled(np.array([r.id for r in own]), p.seed + 1009 * round_ + fold, p.row_share)
        root = []
        for r, s in zip(own, seen, strict=True):
            if s:
                q = 1 / (1 + np.exp(-raw[r.id]))
                w = weight[r.label]
                root.append((r.id, int(np.rint(w * (q - r.label) * B.STEPS)), int(np.rint(w * q * (1 - q) * B.STEPS))))
        columns = B.columns_of(p, range(len(FEATURES)), fold, round_)
        leaves, splits, nodes = {1: best_split(root, columns, 0)}, {}, {1: root}
        while len(leaves) < p.leaves:
            open_ = [(-gain, i) for i, (gain, split) in leaves.items() if split]
            if not open_:
                break
            i = min(open_)[1]
            split = splits[i] = leaves.pop(i)[1]
            for c, side in ((2 * i, True), (2 * i + 1, False)):
                nodes[c] = [x for x in nodes[i] if goes_left(x[0], split) == side]
                leaves[c] = best_split(nodes[c], columns, c.bit_length() - 1)
        value = {i: -p.rate * sums(nodes[i])[0] / (sums(nodes[i])[1] + p.ridge) for i in leaves}
        for r in use:
            i = 1
            while i in splits:
                i = 2 * i + (not goes_left(r.id, splits[i]))
            raw[r.id] += value[i]
        trees.append((splits, value))
        steps = lambda r: min(int(B.AUC_STEPS / (1 + math.exp(-raw[r.id]))), B.AUC_STEPS - 1)
        up, down = [steps(r) for r in held if r.label == 1], [steps(r) for r in held if r.label == 0]
        curve.append(sum((x > y) + (x == y) / 2 for x in up for y in down) / (len(up) * len(down)))
    return trees, curve


@pytest.fixture(scope="module")
def fit(sample):
    return B.boost(sample, FEATURES, ["symbol", "date"], params=SMALL)


def test_trees_equal_those_of_a_plain_version(sample, fit):
    rows, cuts = sample.collect(), B.edges(sample.where("label IS NOT NULL"), FEATURES, SMALL.bins)
    model = {}
    for r in fit.model.collect():
        model.setdefault((r.fold, r.tree), {})[r.node] = r
    assert set(fit.auc) == {0, 1, 2}
    for fold in fit.auc:
        trees, curve = plain(rows, cuts, fold, SMALL)
        assert fit.auc[fold] == pytest.approx(curve[: len(fit.auc[fold])], abs=1e-9)
        best = int(np.argmax(fit.auc[fold])) + 1
        assert fit.best[fold] == best and len(fit.auc[fold]) == min(best + SMALL.patience, SMALL.rounds)
        for k in range(best):
            got, (splits, value) = model[fold, k], trees[k]
            assert {i: (r.feature, r.bin, r.missing_left) for i, r in got.items() if r.feature is not None} == splits
            assert {i: r.value for i, r in got.items() if r.feature is None} == pytest.approx(value, abs=1e-12)


def test_partitions_do_not_matter(sample, fit):
    again = B.boost(sample.repartition(2), FEATURES, ["symbol", "date"], params=SMALL)
    assert sorted(map(str, again.model.collect())) == sorted(map(str, fit.model.collect())) and again.auc == fit.auc


def test_stored_model_scores_alike(spark, sample, fit, tmp_path):
    fit.model.write.parquet(str(tmp_path / "model"))
    read = spark.read.parquet(str(tmp_path / "model"))
    held = sample.where("valid IS NOT NULL")
    got = {(r.symbol, r.date): r for r in B.scored(held, read, FEATURES, ["symbol", "date"], F.col("valid")).collect()}
    nodes = {(r.fold, r.tree, r.node): r for r in read.collect()}
    assert len(got) == held.count()
    for r in held.collect():
        raw = 0.0
        for k in range(fit.best[r.valid]):
            n = nodes[r.valid, k, 1]
            while n.feature is not None:
                x = r[FEATURES[n.feature]]
                n = nodes[r.valid, k, 2 * n.node + (not (n.missing_left if x is None else x <= n.threshold))]
            raw += n.value
        assert got[r.symbol, r.date].raw == pytest.approx(raw, abs=1e-12)
        assert got[r.symbol, r.date].p == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-12)


def test_a_fold_uses_only_its_features(sample):
    got = B.boost(sample, FEATURES, ["symbol", "date"], params=B.Params(rounds=4, patience=9, rate=0.3, depth=3, least_rows=8, bins=16), allowed={0: [0], 1: [1, 2]})
    used = {f: {r.feature for r in got.model.where("feature IS NOT NULL").collect() if r.fold == f} for f in range(3)}
    assert used[0] == {0} and used[1] <= {1, 2} and used[1] and got.best.keys() == {0, 1, 2}


def test_it_learns_and_names_what_it_used(sample, fit):
    assert max(max(c) for c in fit.auc.values()) > 0.7
    gains = {}
    for r in B.importance(fit.model, FEATURES).collect():
        gains[r.feature] = gains.get(r.feature, 0) + r.gain
    assert gains["a"] > gains.get("c", 0) and gains["b"] > gains.get("c", 0)


def test_final_model(sample, fit):
    model = B.final(sample, FEATURES, ["symbol", "date"], fit.best, params=SMALL)
    rounds = sum(fit.best.values()) // len(fit.best)
    assert model.agg(F.countDistinct("tree")).first()[0] == max(1, rounds) and model.select("fold").distinct().count() == 1
    scores = B.scored(sample, model, FEATURES, ["symbol", "date"]).join(sample, ["symbol", "date"]).where("label IS NOT NULL")
    by = {r.label: r.p for r in scores.groupBy("label").agg(F.avg("p").alias("p")).collect()}
    assert by[1] > by[0]


def test_edges(spark):
    schema = "symbol int, date date, a double, label int, train int, valid int"
    day = dt.date(2020, 1, 1)
    for rows in ([], [(1, day, 1.0, None, 1, None)], [(i, day, 1.0, 1, 1, None) for i in range(50)]):
        got = B.boost(spark.createDataFrame(rows, schema), ["a"], ["symbol", "date"], params=SMALL)
        assert got.model.count() == 0
    rows = [(i, day, None if i % 3 else 5.0, i % 2, 1, None) for i in range(100)]  # one value, or none at all
    flat = spark.createDataFrame(rows, schema)
    got = B.boost(flat, ["a"], ["symbol", "date"], params=SMALL).model
    assert got.select("tree").distinct().count() == SMALL.rounds
    assert B.scored(flat, got, ["a"], ["symbol", "date"]).count() == 100


def test_one_partition_is_fitted_in_one_job(spark, sample, monkeypatch):
    few, nodes = B.boost(sample, FEATURES, ["symbol", "date"], params=SMALL), lambda fit: sorted(map(str, fit.model.collect()))
    spark.sparkContext.setJobGroup("long", "")
    B.boost(sample, FEATURES, ["symbol", "date"], params=B.replace(SMALL, rounds=60, patience=60))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20  # before: some for every level of every round
    monkeypatch.setattr(B, "PARTITION_ROWS", 100)  # passes over several partitions give the same trees
    many = B.boost(sample, FEATURES, ["symbol", "date"], params=SMALL)
    assert nodes(few) == nodes(many) and few.best == many.best and few.auc == many.auc
    assert len(few.best) == 3 and min(map(len, few.auc.values())) > 1
