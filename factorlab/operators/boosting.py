"""Gradient-boosted trees over partitions: a pass over the rows sums histograms of gradients by node, feature and
bin; the driver picks splits from these sums, whose size parameters bound and rows don't.

Rows are stored binned, a byte a feature. Gradients are summed as whole numbers, so neither the number of partitions nor
the order of tasks changes a tree. All folds of a cross-validation grow side by side in the same passes. Scores
are stored with the rows every few rounds; in between a pass adds the trees that came since.

Rows that fill one partition only need no passes: there a fold's rows are one task's, which sums the same histograms
and grows the same trees, all folds in one job.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Written
from . import universe as U

#: Bin of unknown values; fixed-point steps of gradients; steps of a probability in the AUC; rounds between stored scores.
MISSING, STEPS, AUC_STEPS, STORE_EVERY = 255, 1 << 20, 1 << 16, 8
#: Rows that a partition of the binned table has at least.
PARTITION_ROWS = 200_000
MODEL = "fold int, tree int, node int, feature int, bin int, threshold double, missing_left boolean, value double, gain double, rows long"


@dataclass(frozen=True)
class Params:
    """rounds at most, rounds without a better AUC before a fold stops, learning rate, depth, leaves, rows in a leaf, shares
    of rows and features a tree sees, ridge term, bins a feature, seed."""

    rounds: int = 1000
    patience: int = 50
    rate: float = 0.05
    depth: int = 5
    leaves: int = 31
    least_rows: int = 50
    row_share: float = 0.8
    feature_share: float = 0.8
    ridge: float = 1.0
    bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """Nodes numbered as a heap (root 1, children 2i and 2i + 1); a node without a split is a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    split: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = 4 << self.depth
        self.feature, self.cut, self.rows = (np.zeros(n, np.int64) for _ in range(3))
        self.missing_left, self.split = np.zeros(n, bool), np.zeros(n, bool)
        self.value, self.gain = np.zeros(n), np.zeros(n)

    def node(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row after so many levels."""
        at, row = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth if levels is None else levels):
            b = bins[row, self.feature[at]]
            left = np.where(b == MISSING, self.missing_left[at], b <= self.cut[at])
            at = np.where(self.split[at], 2 * at + ~left, at)
        return at

    def pruned(self, leaves: int) -> Tree:
        """The tree that best-first growth with so many leaves gives: the splits with the largest gains, parents first."""
        kept, heap, n = set(), [(-self.gain[1], 1)] if self.split[1] else [], 1
        while heap and n < leaves:
            _, i = heapq.heappop(heap)
            kept.add(i)
            n += 1
            for c in (2 * i, 2 * i + 1):
                if self.split[c]:
                    heapq.heappush(heap, (-self.gain[c], c))
        self.split[[i for i in np.flatnonzero(self.split) if i not in kept]] = False
        return self


@dataclass
class Fit:
    """What boost() gives: a table of nodes, the rounds that each fold keeps, and its AUC after each round."""

    model: DataFrame
    best: dict[int, int]
    auc: dict[int, list[float]]


def edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: quantiles of a mergeable sketch, at most bins - 1 a feature."""
    probs = [i / bins for i in range(1, bins)]
    got = df.agg(*(F.percentile_approx(f, probs, 10_000).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [np.unique(np.array(q or [], float)) for q in got]


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], ids: list[str], label: str) -> DataFrame:
    """(id, y, train, valid, bins): the rows of df(ids, label, train, valid, features), a byte a feature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full((b.num_rows, len(features)), MISSING, np.uint8)
            for i, f in enumerate(features):
                x = b.column(f).to_numpy(zero_copy_only=False)
                known = ~np.isnan(x)
                out[known, i] = np.searchsorted(cuts[i], x[known], "left")
            packed = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), b.column("train"), b.column("valid"), packed], ["id", "y", "train", "valid", "bins"])

    rows = df.select(F.xxhash64(*ids).alias("id"), F.col(label).cast("int").alias("y"), F.col("train").cast("int").alias("train"), F.coalesce(F.col("valid").cast("int"), F.lit(-1)).alias("valid"), *(F.col(f).cast("double").alias(f) for f in features))
    return rows.mapInArrow(work, "id long, y int, train int, valid int, bins binary")


def sampled(ids: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by a mixed hash of id and seed: the same rows on any partitioning."""
    x = ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) < share * 2.0**64


def columns_of(p: Params, own: Sequence[int], fold: int, round_: int) -> np.ndarray:
    """The features, of a fold's own, that a tree may split on."""
    k = max(1, math.ceil(p.feature_share * len(own) - 1e-9))
    return np.sort(np.asarray(own, np.int64)[np.random.default_rng([p.seed, fold, round_]).permutation(len(own))[:k]])


def raw_scores(b: pa.RecordBatch, bins: np.ndarray, fold: int, trees: list[Tree]) -> np.ndarray:
    raw = b.column(f"raw{fold}").to_numpy().copy()
    for t in trees:
        raw += t.value[t.node(bins)]
    return raw


def unpacked(b: pa.RecordBatch) -> np.ndarray:
    column = b.column("bins")
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(b.num_rows, -1)


def gradients(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss, in fixed-point steps."""
    p = 1 / (1 + np.exp(-raw))
    return np.rint(weight * (p - y) * STEPS).astype(np.int64), np.rint(weight * p * (1 - p) * STEPS).astype(np.int64)


def opened(tree: Tree, level: int) -> np.ndarray:
    """Which nodes of a level have a parent that splits."""
    wide = 1 << level
    if not level:
        return np.ones(1, bool)
    spots = np.flatnonzero(tree.split[wide // 2 : wide])
    return np.isin(np.arange(wide), np.concatenate((2 * spots, 2 * spots + 1)))


def tallied(hist: np.ndarray, tree: Tree, level: int, open_: np.ndarray, bins: np.ndarray, ids: np.ndarray, y: np.ndarray, raw: np.ndarray, mine: np.ndarray, weights: tuple[float, float], columns: np.ndarray, p: Params, seed: int) -> None:
    """Adds the rows that the tree sees to the sums of the level's nodes (both gradients and rows; node, feature, bin)."""
    wide, n = 1 << level, bins.shape[1]
    use = np.flatnonzero(mine & sampled(ids, seed, p.row_share))
    node = tree.node(bins[use], level) - wide
    on = (node >= 0) & open_[np.maximum(node, 0)]
    use, node = use[on], node[on]
    g, h = gradients(raw[use], y[use], np.where(y[use] == 1, weights[1], weights[0]))
    cells = ((node * n)[:, None] + columns) * 256 + bins[use][:, columns]
    for k, v in enumerate((g, h, np.ones(len(g), np.int64))):  # whole numbers below 2^53 in a batch
        hist[k] += np.bincount(cells.ravel(), np.repeat(v, len(columns)), wide * n * 256).astype(np.int64)


def stepped(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows with label 1 and 0 by steps of their probability."""
    at = np.minimum((AUC_STEPS / (1 + np.exp(-raw))).astype(np.int64), AUC_STEPS - 1)
    return np.stack([np.bincount(at[y == 1 - k], minlength=AUC_STEPS) for k in (0, 1)])


def passed(rows: DataFrame, n: int, p: Params, round_: int, pending: dict[int, list[Tree]], growing: dict[int, Tree], level: int, weights: dict[int, tuple[float, float]], own: dict[int, Sequence[int]], judge: bool) -> dict[int, dict[str, np.ndarray]]:
    """One pass: by fold `hist` (node of the level, feature, bin; sums of both gradients and rows) and, if asked, `auc`
    (steps of the validation rows' probability; rows with label 1 and 0)."""
    wide = 1 << level
    open_ = {f: opened(t, level) for f, t in growing.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = {f: np.zeros((3, wide * n * 256), np.int64) for f in growing}
        seen = {f: np.zeros((2, AUC_STEPS), np.int64) for f in growing}
        for b in batches:
            bins, y, train, valid = unpacked(b), b.column("y").to_numpy(), b.column("train").to_numpy(), b.column("valid").to_numpy()
            ids = b.column("id").to_numpy()
            for f, tree in growing.items():
                mine, held = (train >> f & 1) == 1, valid == f
                need = mine | held if judge else mine
                if not need.any():
                    continue
                raw = np.zeros(len(y))
                raw[need] = raw_scores(b.filter(pa.array(need)), bins[need], f, pending[f])
                if judge and held.any():
                    seen[f] += stepped(raw[held], y[held])
                tallied(hist[f], tree, level, open_[f], bins, ids, y, raw, mine, weights[f], columns_of(p, own[f], f, round_), p, p.seed + 1009 * round_ + f)
        for kind, tables in ((0, hist), (1, seen)):
            for f, t in tables.items():
                cells = np.flatnonzero(t.any(0))
                sums = [pa.array(t[k][cells] if k < len(t) else np.zeros(len(cells), np.int64)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), 2 * f + kind, np.int32)), pa.array(cells), *sums], ["what", "cell", "a", "b", "c"])

    sums = rows.mapInArrow(work, "what int, cell long, a long, b long, c long").groupBy("what", "cell").agg(*(F.sum(c).alias(c) for c in "abc")).toArrow()
    what, cell = sums.column("what").to_numpy(), sums.column("cell").to_numpy()
    out = {f: {"hist": np.zeros((3, wide * n * 256), np.int64), "auc": np.zeros((2, AUC_STEPS), np.int64)} for f in growing}
    for k, c in enumerate("abc"):
        v = sums.column(c).to_numpy()
        for f in growing:
            out[f]["hist"][k][cell[what == 2 * f]] = v[what == 2 * f]
            if k < 2:
                out[f]["auc"][k][cell[what == 2 * f + 1]] = v[what == 2 * f + 1]
    return out


def grown(tree: Tree, level: int, hist: np.ndarray, n: int, cuts: list[np.ndarray], columns: np.ndarray, p: Params) -> None:
    """Splits the level's nodes where that gains, and gives every node its value."""
    wide = 1 << level
    g, h, k = (x.reshape(wide, n, 256) for x in hist)
    scale = float(STEPS)
    for i in range(wide):
        if not k[i].any():
            continue
        first = int(columns[0])
        big_g, big_h, rows = int(g[i, first].sum()) / scale, int(h[i, first].sum()) / scale, int(k[i, first].sum())
        node = wide + i
        tree.value[node], tree.rows[node] = -p.rate * big_g / (big_h + p.ridge), rows
        if rows < 2 * p.least_rows:
            continue
        best = (1e-9, None, None)
        for c in columns:
            last = len(cuts[c])
            if not last:
                continue
            miss = [x[i, c, MISSING] for x in (g, h, k)]
            below = [np.cumsum(x[i, c, :last]) for x in (g, h, k)]
            for way in (False, True) if miss[2] else (None,):
                gl, hl, kl = ((x + m if way else x) for x, m in zip(below, miss, strict=True))
                gl, hl, kr = gl / scale, hl / scale, rows - kl
                gain = gl**2 / (hl + p.ridge) + (big_g - gl) ** 2 / (big_h - hl + p.ridge) - big_g**2 / (big_h + p.ridge)
                gain[(kl < p.least_rows) | (kr < p.least_rows) | (hl < 1e-3) | (big_h - hl < 1e-3)] = -np.inf
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (float(gain[j]), (int(c), j, bool(2 * kl[j] > rows) if way is None else way), (gl[j], hl[j], int(kl[j])))
        if best[1]:
            tree.split[node], tree.gain[node] = True, best[0]
            tree.feature[node], tree.cut[node], tree.missing_left[node] = best[1]
            gl, hl, kl = best[2]  # children at the last level get no pass of their own
            for child, cg, ch, ck in ((2 * node, gl, hl, kl), (2 * node + 1, big_g - gl, big_h - hl, rows - kl)):
                tree.value[child], tree.rows[child] = -p.rate * cg / (ch + p.ridge), ck


def auc(seen: np.ndarray) -> float:
    """Area under the curve from the rows with label 1 and 0 of each step; half for pairs of one step."""
    up, down = seen.astype(float)
    pairs = up.sum() * down.sum()
    return float((up * (np.cumsum(down) - down / 2)).sum() / pairs) if pairs else float("nan")


def stored(rows: DataFrame, pending: dict[int, list[Tree]], folds: int) -> Written:
    """The rows with the pending trees added to their scores."""
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = unpacked(b)
            raws = [pa.array(raw_scores(b, bins, f, pending.get(f, []))) for f in range(folds)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "y", "train", "valid", "bins")), *raws], names)

    return Written(rows.mapInArrow(work, rows.schema))


def alone(bins: np.ndarray, ids: np.ndarray, y: np.ndarray, mine: np.ndarray, held: np.ndarray, fold: int, cuts: list[np.ndarray], own: Sequence[int], p: Params) -> tuple[list[Tree], list[float]]:
    """One fold's trees and AUC after each round from all of its rows: the rounds of boost() without passes."""
    n, raw, trees, curve = bins.shape[1], np.zeros(len(y)), [], []
    k = [int((mine & (y == c)).sum()) for c in (0, 1)]
    if not all(k):
        return trees, curve
    weights, judge = (sum(k) / (2 * k[0]), sum(k) / (2 * k[1])), bool(held.any())
    for round_ in range(p.rounds + 1):
        if judge and round_:
            curve.append(auc(stepped(raw[held], y[held])))
            if round_ - best_round(curve) >= p.patience:
                break
        if round_ == p.rounds:
            break
        tree, columns = Tree(p.depth), columns_of(p, own, fold, round_)
        for level in range(p.depth):
            open_ = opened(tree, level)
            if not open_.any():
                break
            hist = np.zeros((3, (1 << level) * n * 256), np.int64)
            tallied(hist, tree, level, open_, bins, ids, y, raw, mine, weights, columns, p, p.seed + 1009 * round_ + fold)
            grown(tree, level, hist, n, cuts, columns, p)
        trees.append(tree.pruned(p.leaves))
        raw += tree.value[tree.node(bins)]
    return trees, curve


def best_round(curve: list[float]) -> int:
    """The round with the highest AUC, of equal ones the first; 0: none."""
    best = 0
    for i, v in enumerate(curve):
        if v > max(curve[:i], default=-1.0):
            best = i + 1
    return best


def in_one_job(rows: DataFrame, folds: int, n: int, cuts: list[np.ndarray], own: dict[int, Sequence[int]], p: Params) -> Fit:
    """The fit from binned rows of one partition's size: a task has the rows of a fold, which it learns from or is judged by."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(unpacked(b), *(b.column(c).to_numpy() for c in ("id", "y", "train", "valid", "fold"))) for b in batches if b.num_rows]
        if not got:
            return
        bins, ids, y, train, valid, fold = (np.concatenate(c) for c in zip(*got, strict=True))
        for f in map(int, np.unique(fold)):
            at = fold == f
            trees, curve = alone(bins[at], ids[at], y[at], (train[at] >> f & 1) == 1, valid[at] == f, f, cuts, own[f], p)
            kept = best_round(curve) if (valid[at] == f).any() else len(trees)
            out = [(*r, None, None) for k, t in enumerate(trees[:kept]) for r in nodes_of(f, k, t, cuts)]
            columns = zip(*out, (f, *[None] * 9, kept, curve), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = f"{MODEL}, kept int, auc array<double>"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.float64())]
    places = F.expr(f"filter(sequence(0, {folds - 1}), f -> (shiftright(train, f) & 1) = 1 OR valid = f)")
    got = Written(rows.withColumn("fold", F.explode(places)).repartitionById(folds, F.col("fold")).mapInArrow(work, schema)).df
    best, curve = {f: 0 for f in range(folds)}, {f: [] for f in range(folds)}
    for r in got.where(F.col("kept").isNotNull()).collect():  # a row a fold
        best[r["fold"]], curve[r["fold"]] = r["kept"], list(r["auc"])
    return Fit(got.where(F.col("kept").isNull()).drop("kept", "auc"), best, curve)


def boost(df: DataFrame, features: list[str], ids: list[str], label: str = "label", params: Params = Params(), allowed: dict[int, Sequence[int]] | None = None) -> Fit:
    """Boosted trees of every fold of df(ids, label, train, valid, features): bit f of `train` says that fold f learns from
    the row, `valid` names the fold that it is held out of (null: none). Rows without a label aren't learned from.

    A fold stops after `patience` rounds without a better AUC on its held-out rows and keeps the rounds up to the best one;
    without held-out rows all `rounds` are kept. `allowed` names the features (by place) that a fold may use. Labels are weighted to equal shares by fold.
    """
    known = df.where(F.col(label).isNotNull())
    cuts = edges(known, features, params.bins)
    total, mask = known.agg(F.count(F.lit(1)), F.bit_or("train")).first()
    folds, n = int(mask or 0).bit_length(), len(features)
    own = {f: (allowed or {}).get(f, range(n)) for f in range(folds)}
    rows, parts = binned(known, features, cuts, ids, label), max(1, min(total // PARTITION_ROWS, 10_000))
    if parts == 1 and folds:
        return in_one_job(rows, folds, n, cuts, own, params)
    first = rows.withColumns({f"raw{f}": F.lit(0.0) for f in range(folds)})
    table = Written(first.repartition(parts, "id"))
    counts = {(r["fold"], r["y"]): r["k"] for r in table.df.select("y", F.explode(F.expr(f"filter(sequence(0, {max(folds - 1, 0)}), f -> (shiftright(train, f) & 1) = 1)")).alias("fold")).groupBy("fold", "y").agg(F.count(F.lit(1)).alias("k")).collect()}
    held = {r["valid"] for r in table.df.select("valid").distinct().collect()}
    weights = {f: tuple((counts.get((f, 0), 0) + counts.get((f, 1), 0)) / (2 * max(counts.get((f, y), 0), 1)) for y in (0, 1)) for f in range(folds)}
    active = [f for f in range(folds) if (f, 0) in counts and (f, 1) in counts]
    trees: dict[int, list[Tree]] = {f: [] for f in range(folds)}
    pending: dict[int, list[Tree]] = {f: [] for f in range(folds)}
    curve: dict[int, list[float]] = {f: [] for f in range(folds)}
    best = {f: 0 for f in range(folds)}

    for round_ in range(params.rounds + 1):
        for level in range(params.depth):
            if level == 0:
                growing = {f: Tree(params.depth) for f in active}
            judge = level == 0 and round_ > 0 and any(f in held for f in active)
            if not growing or (round_ == params.rounds and not judge):
                break
            if level and not any(t.split[1 << level - 1 : 1 << level].any() for t in growing.values()):
                break
            got = passed(table.df, n, params, round_, pending, growing, level, weights, own, judge)
            if judge:  # the AUC after the round before, from the same pass that begins this one
                for f in [f for f in active if f in held]:
                    curve[f].append(auc(got[f]["auc"]))
                    if curve[f][-1] > max(curve[f][:-1], default=-1.0):
                        best[f] = round_
                    if round_ - best[f] >= params.patience or round_ == params.rounds:
                        active.remove(f)
                        del growing[f]
            for f, t in growing.items():
                grown(t, level, got[f]["hist"], n, cuts, columns_of(params, own[f], f, round_), params)
        if round_ == params.rounds or not growing:
            break
        for f, t in growing.items():
            trees[f].append(t.pruned(params.leaves))
            pending[f].append(trees[f][-1])
        if (round_ + 1) % STORE_EVERY == 0:
            before, table = table, stored(table.df, pending, folds)
            before.delete()
            pending = {f: [] for f in range(folds)}
    table.delete()
    best = {f: best[f] if f in held else len(trees[f]) for f in range(folds)}
    return Fit(as_table(df.sparkSession, trees, best, cuts), best, curve)


def as_table(spark: SparkSession, trees: dict[int, list[Tree]], best: dict[int, int], cuts: list[np.ndarray]) -> DataFrame:
    """The nodes of the rounds that each fold keeps: at most folds x rounds x 2 leaves rows."""
    rows = [r for f, own in trees.items() for k, t in enumerate(own[: best[f]]) for r in nodes_of(f, k, t, cuts)]
    return spark.createDataFrame(rows, MODEL)


def nodes_of(fold: int, k: int, t: Tree, cuts: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of MODEL: the nodes that a row can reach."""
    reach = [1]
    for i in reach:
        if t.split[i]:
            reach += [2 * i, 2 * i + 1]
            c, cut = int(t.feature[i]), int(t.cut[i])
            yield fold, k, i, c, cut, float(cuts[c][cut]), bool(t.missing_left[i]), None, float(t.gain[i]), int(t.rows[i])
        else:
            yield fold, k, i, None, None, None, None, float(t.value[i]), None, int(t.rows[i])


def scored(df: DataFrame, model: DataFrame, features: list[str], keys: list[str], fold: Column | None = None, depth: int = Params.depth) -> DataFrame:
    """(keys, raw, p): rows of df by a model's table, which is joined level by level: a row and a tree meet the tree's nodes on
    their way down. `fold` names the fold whose trees judge a row (default: 0). The model's size is bounded by its
    parameters, so it is broadcast and rows aren't moved but for the sum of their trees' values."""
    mine = df.select(*keys, (F.lit(0) if fold is None else fold).cast("int").alias("_fold"), F.array(*(F.col(f).cast("double") for f in features)).alias("_x"))
    roots = model.where(F.col("node") == 1).select(F.col("fold").alias("_fold"), F.col("tree").alias("_tree"))
    at = mine.join(F.broadcast(roots), "_fold").withColumns({"_node": F.lit(1), "_v": F.lit(None).cast("double")})
    nodes = model.select(F.col("fold").alias("_fold"), F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("feature").alias("_f"), "threshold", "missing_left", "value")
    for _ in range(depth + 1):
        x = F.col("_x")[F.col("_f")]
        left = F.when(x.isNull() | F.isnan(x), F.col("missing_left")).otherwise(x <= F.col("threshold"))
        met = at.join(F.broadcast(nodes), ["_fold", "_tree", "_node"], "left")  # a node below a leaf meets none
        at = met.select(*keys, "_fold", "_x", "_tree", F.when(F.col("_f").isNotNull(), 2 * F.col("_node") + (~left).cast("int")).alias("_node"), F.coalesce("_v", "value").alias("_v"))
    sums = at.groupBy(*keys).agg(F.sum(F.coalesce("_v", F.lit(0.0))).alias("raw"))
    return sums.withColumn("p", 1 / (1 + F.exp(-F.col("raw"))))


def with_folds(df: DataFrame, splits: int = 5, purge: int = 6) -> DataFrame:
    """df with `train` and `valid` of a purged split by date: training before the held-out dates, `purge` dates between."""
    placed = U.placed_in_folds(df.select("symbol", "date"), splits, purge)
    marks = placed.groupBy("symbol", "date").agg(F.sum(F.when(F.col("part") == "train", F.expr("shiftleft(1, fold)")).otherwise(0)).cast("int").alias("train"), F.max(F.when(F.col("part") == "validation", F.col("fold"))).alias("valid"))
    return df.join(marks, ["symbol", "date"], "left").withColumn("train", F.coalesce("train", F.lit(0)))


def importance(model: DataFrame, features: list[str]) -> DataFrame:
    """(fold, feature, gain, splits) of the features that a fold's trees split on."""
    names = F.array(*map(F.lit, features))
    return model.where(F.col("feature").isNotNull()).groupBy("fold", names[F.col("feature")].alias("feature")).agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))


def final(df: DataFrame, features: list[str], ids: list[str], best: dict[int, int], label: str = "label", params: Params = Params()) -> DataFrame:
    """The model of all labelled rows: as many rounds as the folds keep on average (rounded down, one at least)."""
    rounds = max(1, sum(best.values()) // max(1, len(best)))
    every = df.withColumns({"train": F.lit(1), "valid": F.lit(None).cast("int")})
    return boost(every, features, ids, label, replace(params, rounds=rounds)).model
