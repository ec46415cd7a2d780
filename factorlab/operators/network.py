"""A feed-forward network with batch normalisation and dropout, trained in barrier tasks: each task holds its part of
the rows, every step all tasks exchange the sums of their gradients and make the same update.

Rows are dealt by a hash of their keys and ordered by it, sums are added in the order of the tasks, and random numbers
depend on seed, fold, epoch, step and task: with the same number of tasks a run gives the same network again, also
after a task was lost, when Spark starts the whole barrier stage anew. Each task normalises its part of a batch by
that part's mean and variance; the running ones, used for scoring, are means over the tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting

#: Rows that a task holds at most; steps of a probability in the AUC.
TASK_ROWS, AUC_STEPS = 2_000_000, 1 << 12
MODEL = "fold int, epoch int, name string, shape array<int>, value array<double>"
State = dict[str, np.ndarray]


@dataclass(frozen=True)
class Params:
    """Widths of the hidden layers, epochs at most, epochs without a better AUC before a fold stops, rows in a batch, learning
    rate, decay of weights, share dropped, seed, tasks (0: by the number of rows)."""

    layers: tuple[int, ...] = (128, 64, 32)
    epochs: int = 200
    patience: int = 20
    batch: int = 4096
    rate: float = 1e-3
    decay: float = 1e-5
    dropout: float = 0.3
    seed: int = 42
    tasks: int = 0


def started(n: int, p: Params, fold: int) -> tuple[State, State]:
    """Parameters and running statistics before the first step."""
    rng = np.random.default_rng([p.seed, fold])
    w, run = {}, {}
    for i, (a, b) in enumerate(zip((n, *p.layers), (*p.layers, 1), strict=True)):
        edge = 1 / np.sqrt(a)
        w[f"w{i}"], w[f"b{i}"] = rng.uniform(-edge, edge, (a, b)), rng.uniform(-edge, edge, b)
        if i < len(p.layers):
            w[f"g{i}"], w[f"s{i}"] = np.ones(b), np.zeros(b)
            run[f"m{i}"], run[f"v{i}"] = np.zeros(b), np.ones(b)
    return w, run


def forward(w: State, run: State, x: np.ndarray) -> np.ndarray:
    """Raw scores with running statistics and without dropout."""
    depth = sum(k.startswith("g") for k in w)
    for i in range(depth):
        z = x @ w[f"w{i}"] + w[f"b{i}"]
        x = np.maximum((z - run[f"m{i}"]) / np.sqrt(run[f"v{i}"] + 1e-5) * w[f"g{i}"] + w[f"s{i}"], 0)
    return (x @ w[f"w{depth}"] + w[f"b{depth}"])[:, 0]


def backward(w: State, x: np.ndarray, y: np.ndarray, up: float, keep: list[np.ndarray]) -> tuple[float, State, State]:
    """Sums over the rows of the logistic loss (rows with label 1 count `up` times) and of its gradients; and the
    rows' mean and variance of each layer. keep: dropout masks of the layers, scaled."""
    depth, inputs, hats, devs, seen = len(keep), [x], [], [], {}
    for i in range(depth):
        z = inputs[-1] @ w[f"w{i}"] + w[f"b{i}"]
        mean, var = z.mean(0), z.var(0)
        devs.append(np.sqrt(var + 1e-5))
        hats.append((z - mean) / devs[-1])
        seen[f"m{i}"], seen[f"v{i}"] = mean, var * len(x) / max(len(x) - 1, 1)
        inputs.append(np.maximum(hats[-1] * w[f"g{i}"] + w[f"s{i}"], 0) * keep[i])
    raw = (inputs[-1] @ w[f"w{depth}"] + w[f"b{depth}"])[:, 0]
    weight = np.where(y == 1, up, 1.0)
    loss = float((weight * (np.logaddexp(0, raw) - y * raw)).sum())
    grad: State = {}
    back = (weight * (1 / (1 + np.exp(-raw)) - y))[:, None]
    for i in range(depth, -1, -1):
        grad[f"w{i}"], grad[f"b{i}"] = inputs[i].T @ back, back.sum(0)
        if i:
            back = back @ w[f"w{i}"].T * (inputs[i] > 0) * keep[i - 1]
            grad[f"g{i - 1}"], grad[f"s{i - 1}"] = (back * hats[i - 1]).sum(0), back.sum(0)
            hat = back * w[f"g{i - 1}"]
            back = (hat - hat.mean(0) - hats[i - 1] * (hat * hats[i - 1]).mean(0)) / devs[i - 1]
    return loss, grad, seen


class Adam:
    """Adam with decoupled decay of weights."""

    def __init__(self, w: State, p: Params):
        self.m, self.v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
        self.t, self.rate, self.decay = 0, p.rate, p.decay

    def step(self, w: State, grad: State) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            w[k] -= self.rate * self.decay * w[k] + self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class Fold:
    """Training of one fold's network; all tasks hold the same one."""

    def __init__(self, n: int, p: Params, fold: int):
        self.w, self.run = started(n, p, fold)
        self.adam, self.best, self.epoch, self.waited, self.curve = Adam(self.w, p), ({}, {}), 0, 0, []
        self.top = self.plateau = 0.0

    def judged(self, auc: float, epoch: int, p: Params) -> bool:
        """Notes the epoch's AUC; whether the fold goes on. The rate halves after more than 10 epochs without a rise."""
        self.curve.append(auc)
        if auc > self.plateau * 1.0001:
            self.plateau, self.waited = auc, 0
        else:
            self.waited += 1
            if self.waited > 10:
                self.adam.rate, self.waited = self.adam.rate / 2, 0
        if auc > self.top or not self.best[0]:
            self.top, self.epoch, self.best = auc, epoch, ({k: a.copy() for k, a in self.w.items()}, {k: a.copy() for k, a in self.run.items()})
        return epoch - self.epoch < p.patience


class Exchange:
    """Sums of vectors over the tasks of a barrier stage. The first task listens on a port that it tells the others in a
    barrier message, with a key for this run; it adds the vectors in the order of the tasks and sends the sum
    back. (A barrier message of its own for every step would take about a second each.) A task that is lost breaks the connections, and
    Spark starts the stage anew."""

    def __init__(self, ctx: BarrierTaskContext):
        self.rank, self.peers = ctx.partitionId(), len(ctx.getTaskInfos())
        self.links: list[Connection] = []
        if self.peers == 1:
            return
        listener = Listener(("0.0.0.0", 0), backlog=self.peers, authkey=(key := os.urandom(16))) if self.rank == 0 else None
        told = ctx.allGather(f"{listener.address[1]} {key.hex()}" if listener else "")[0].split()
        if listener:
            met = {}
            while len(met) < self.peers - 1:
                link = listener.accept()
                met[int(link.recv_bytes())] = link
            self.links = [met[k] for k in sorted(met)]
            listener.close()
        else:
            host = ctx.getTaskInfos()[0].address.rsplit(":", 1)[0]
            self.links = [Client((host, int(told[0])), authkey=bytes.fromhex(told[1]))]
            self.links[0].send_bytes(str(self.rank).encode())

    def sum(self, own: np.ndarray) -> np.ndarray:
        own = own.astype(np.float64)
        if self.peers == 1:
            return own
        if self.rank:
            self.links[0].send_bytes(own.tobytes())
            return np.frombuffer(self.links[0].recv_bytes(), np.float64)
        total = np.sum([own, *(np.frombuffer(link.recv_bytes(), np.float64) for link in self.links)], axis=0)
        for link in self.links:
            link.send_bytes(total.tobytes())
        return total


def one_step(peers: Exchange, folds: dict[int, Fold], batches: dict[int, np.ndarray], x: np.ndarray, y: np.ndarray, up: dict[int, float], p: Params, seed: list[int]) -> None:
    """Every fold's step: gradients of the tasks' rows are summed in one exchange, then all tasks update alike."""
    message = []
    for f, one in folds.items():
        mine = batches[f]
        grad, seen, n = {k: np.zeros_like(a) for k, a in one.w.items()}, {k: np.zeros_like(a) for k, a in one.run.items()}, 0
        if len(mine) > 1:  # a single row has no variance
            rng = np.random.default_rng([p.seed, f, *seed])
            keep = [(rng.random((len(mine), width)) >= p.dropout) / (1 - p.dropout) for width in p.layers]
            _, grad, seen = backward(one.w, x[mine], y[mine], up[f], keep)
            n = len(mine)
        message += [np.array([n]), *(grad[k].ravel() for k in one.w), *(n * seen[k] for k in one.run)]
    total, at = peers.sum(np.concatenate(message)), 0

    def taken(shape: tuple[int, ...]) -> np.ndarray:
        nonlocal at
        size = int(np.prod(shape))
        at += size
        return total[at - size : at].reshape(shape)

    for one in folds.values():
        n = taken((1,))[0]
        grad, seen = {k: taken(a.shape) for k, a in one.w.items()}, {k: taken(a.shape) for k, a in one.run.items()}
        if n:
            one.adam.step(one.w, {k: g / n for k, g in grad.items()})
            for k in one.run:
                one.run[k] = 0.9 * one.run[k] + 0.1 * seen[k] / n


def fitted(peers: Exchange, x: np.ndarray, y: np.ndarray, train: np.ndarray, valid: np.ndarray, folds: int, p: Params) -> dict[int, Fold]:
    """What one task does: its rows in the order of their keys, all folds side by side."""
    rank = peers.rank
    own = {f: np.flatnonzero((train >> f & 1) == 1) for f in range(folds)}
    counts = peers.sum(np.array([[(y[own[f]] == k).sum() for k in (0, 1)] + [(valid == f).sum()] for f in range(folds)], float).ravel()).reshape(folds, 3)
    nets = {f: Fold(x.shape[1], p, f) for f in range(folds) if counts[f].all()}
    up = {f: counts[f][0] / counts[f][1] for f in nets}
    active = dict(nets)
    for epoch in range(1, p.epochs + 1):
        if not active:
            break
        steps = {f: max(1, int(-(-counts[f][:2].sum() // p.batch))) for f in active}
        dealt = {f: np.array_split(np.random.default_rng([p.seed, f, epoch, rank]).permutation(own[f]), steps[f]) for f in active}
        for s in range(max(steps.values())):
            now = {f: one for f, one in active.items() if s < steps[f]}
            one_step(peers, now, {f: dealt[f][s] for f in now}, x, y, up, p, [epoch, s, rank])
        seen = np.zeros((len(active), 2, AUC_STEPS))
        for i, (f, one) in enumerate(active.items()):
            held = np.flatnonzero(valid == f)
            if len(held):
                at = np.minimum((AUC_STEPS / (1 + np.exp(-forward(one.w, one.run, x[held])))).astype(int), AUC_STEPS - 1)
                for k in (0, 1):
                    seen[i, k] = np.bincount(at[y[held] == 1 - k], minlength=AUC_STEPS)
        seen = peers.sum(seen.ravel()).reshape(seen.shape)
        active = {f: one for i, (f, one) in enumerate(active.items()) if one.judged(boosting.auc(seen[i]), epoch, p)}
    return nets


def filled(df: DataFrame, features: list[str], label: str) -> tuple[list[float], list[float], list[float]]:
    """Median (for unknown values), mean and deviation of each feature over the labelled rows."""
    known = df.where(F.col(label).isNotNull())
    got = known.agg(*(a for i, f in enumerate(features) for a in (F.percentile_approx(f, 0.5, 10_000).alias(f"q{i}"), F.avg(f).alias(f"m{i}"), F.stddev_samp(f).alias(f"s{i}")))).first()
    pick = lambda c, other: [float(got[f"{c}{i}"]) if got[f"{c}{i}"] else other for i in range(len(features))]
    return pick("q", 0.0), pick("m", 0.0), pick("s", 1.0)


def ready(features: list[str], scale: tuple[list[float], list[float], list[float]]) -> Column:
    """The features as one array: unknown ones at their median, then standardised."""
    return F.array(*((F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(q)) - m) / s for f, q, m, s in zip(features, *scale, strict=True)))


def train(df: DataFrame, features: list[str], ids: list[str], label: str = "label", params: Params = Params()) -> tuple[DataFrame, tuple[list[float], list[float], list[float]]]:
    """A table of every fold's best network and of its AUC by epoch (name 'auc'), and the features' scale, which scored() needs.
    df(ids, label, train, valid, features) as for boosted trees. Folds without both labels or held-out rows have no network."""
    known, p = df.where(F.col(label).isNotNull()), params
    scale = filled(df, features, label)
    total, mask = known.agg(F.count(F.lit(1)), F.bit_or("train")).first()
    folds = int(mask or 0).bit_length()
    tasks = p.tasks or max(1, -(-total // TASK_ROWS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peers = Exchange(BarrierTaskContext.get())
        got = [(b.column("id").to_numpy(), b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), *(b.column(c).to_numpy() for c in ("y", "train", "valid"))) for b in batches if b.num_rows]
        empty = (np.zeros(0, np.int64), np.zeros((0, len(features))), *(np.zeros(0, np.int64) for _ in range(3)))
        i, x, y, mine, held = (np.concatenate(c) for c in zip(*got, strict=True)) if got else empty
        order = np.argsort(i, kind="stable")
        nets = fitted(peers, x[order], y[order], mine[order], held[order], folds, p)
        if peers.rank == 0:  # all tasks hold the same networks
            rows = [(f, one.epoch, k, list(a.shape), a.ravel().tolist()) for f, one in nets.items() for k, a in (one.best[0] | one.best[1] | {"auc": np.array(one.curve)}).items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["fold", "epoch", "name", "shape", "value"])

    rows = known.select(F.xxhash64(*ids).alias("id"), ready(features, scale).alias("x"), F.col(label).cast("int").alias("y"), F.col("train").cast("int").alias("train"), F.coalesce(F.col("valid").cast("int"), F.lit(-1)).alias("valid"))
    return boosting.Written(rows.repartition(tasks, "id").mapInArrow(work, MODEL, barrier=True)).df, scale


def scored(df: DataFrame, model: DataFrame, scale: tuple[list[float], list[float], list[float]], features: list[str], keys: list[str], fold: Column | None = None) -> DataFrame:
    """(keys, p): rows of df by the networks of a table, whose size the layers bound. Rows of folds without one are left out."""
    nets: dict[int, State] = {}
    for r in model.where("name <> 'auc'").collect():
        nets.setdefault(r["fold"], {})[r["name"]] = np.array(r["value"]).reshape(r["shape"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, of = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), b.column("fold").to_numpy()
            p = np.zeros(b.num_rows)
            for f, net in nets.items():
                p[of == f] = 1 / (1 + np.exp(-forward(net, net, x[of == f])))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(p)], [*keys, "p"])

    rows = df.select(*keys, (F.lit(0) if fold is None else fold).cast("int").alias("fold"), ready(features, scale).alias("x")).where(F.col("fold").isin(list(nets)))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(work, f"{kinds}, p double")
