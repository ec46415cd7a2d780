"""The planner's expressions over arrays: the histories of some symbols as matrices (symbols x dates), or a slice of consecutive
dates, date by date over all symbols.

A node is worth NaN where the planner's column is null. Cross-sections and short windows, of cross-sections too, are computed in
slices from the fields of the slice and of the few dates before it; what looks further back is computed over whole histories.
Sums run over a window in the same order as the planner's windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

from ..functions.expr import SCALAR, SECTION, Expr
from .planner import STEPS, nodes

_BOOLEAN = ("lt", "le", "eq", "and", "known")


def phases(roots: Iterable[Expr]) -> dict[Expr, int]:
    """The first phase in which a node can be computed."""
    out: dict[Expr, int] = {}
    for x in nodes(roots):
        at = max((out[a] for a in x.args), default=0)
        out[x] = at if x.kind == SCALAR or at % 2 == (x.kind == SECTION) else at + 1
    return out


def carried(consumed: Iterable[Expr], at: dict[Expr, int], phase: int) -> list[Expr]:
    """What must be handed on after a phase: the largest parts of what later phases read that are known by then."""
    out: dict[Expr, None] = {}

    def visit(x: Expr) -> None:
        if at[x] <= phase and x.op not in _BOOLEAN:
            if x.op != "const":
                out[x] = None
        else:
            for a in x.args:
                visit(a)

    for x in consumed:
        visit(x)
    return list(out)


def program(outputs: Sequence[Expr], given: Sequence[Expr]) -> tuple[list[tuple], list[int]]:
    """Steps (op, params, places of the arguments, whether these may be infinite) after the given ones, and the outputs' places."""
    place, steps = {x: i for i, x in enumerate(given)}, []

    def visit(x: Expr) -> int:
        if x not in place:
            args = tuple(map(visit, x.args))
            steps.append((x.op, x.params, args, tuple(a.may_be_infinite for a in x.args)))
            place[x] = len(given) + len(steps) - 1
        return place[x]

    return steps, [visit(x) for x in outputs]


def run(steps: list[tuple], given: list[np.ndarray]) -> list[np.ndarray]:
    """The given arrays and one for each step."""
    values = list(given)
    with np.errstate(all="ignore"):
        for op, params, args, infinite in steps:
            values.append(value(op, params, [values[i] for i in args], infinite, values[0].shape))
    return values


def stepped(x: np.ndarray) -> np.ndarray:
    return np.rint(x * STEPS) / STEPS


def mean_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties by their mean; all values are known."""
    order = np.argsort(x)
    v = x[order]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(x) else np.zeros(0, int)
    ends, out = np.append(starts[1:], len(x)), np.empty(len(x))
    out[order] = np.repeat((starts + 1 + ends) / 2.0, ends - starts)
    return out


def shares(x: np.ndarray) -> np.ndarray:
    """Ranks of known values from the smallest, ties by their mean, over their number."""
    known, out = ~np.isnan(x), np.full(x.shape, np.nan)
    out[known] = mean_ranks(x[known]) / max(int(known.sum()), 1)
    return out


def recursive_means(x: np.ndarray, n: int, m: int) -> np.ndarray:
    """The planner's recursive_mean() of each row."""
    out = np.full(x.shape, np.nan)
    if x.shape[1] >= n:
        out[:, n:] = pd.DataFrame(x.T).ewm(alpha=m / n, adjust=False, ignore_na=True).mean().to_numpy().T[:, n:]
        known = ~np.isnan(x[:, :n])
        out[:, n - 1] = np.where(known, x[:, :n], 0.0).sum(1) / known.sum(1)
    return out


def windows(x: np.ndarray, n: int) -> list[np.ndarray]:
    """The values n - 1, ..., 0 rows before, unknown before the first row."""
    wide, t = np.concatenate([np.full((len(x), n - 1), np.nan), x], 1), x.shape[1]
    return [wide[:, k : k + t] for k in range(n)]


def moments(x: list[np.ndarray]) -> np.ndarray:
    """Population variance of each window."""
    mean = m2 = 0.0
    for k, v in enumerate(x, 1):
        d = v - mean
        step = d / k
        mean += step
        np.subtract(d, step, out=step)
        step *= d
        m2 += step
    return m2 / len(x)


def comoments(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sum of products of deviations."""
    mx = my = c = 0.0
    for k, (u, v) in enumerate(zip(x, y, strict=True), 1):
        d = u - mx
        mx += d / k
        step = v - my
        step /= k
        my += step
        np.subtract(v, my, out=step)
        step *= d
        c += step
    return c


def least_most(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    low = high = x[0]
    for v in x[1:]:
        low, high = np.minimum(low, v), np.maximum(high, v)
    return low, high


def value(op: str, params: tuple, a: list, infinite: tuple, shape: tuple, windows: Callable = windows) -> np.ndarray:
    """One node. Arguments of series are what windows() takes: matrices, or the last values in a slice."""
    match op:
        case "const":
            return np.full(shape, np.nan if params[0] is None else params[0])
        case "add":
            return a[0] + a[1]
        case "sub":
            return a[0] - a[1]
        case "mul":
            return a[0] * a[1]
        case "div":
            zero = np.where(a[0] > 0, np.inf, np.where(a[0] < 0, -np.inf, np.nan))
            return np.where(a[1] == 0, zero, a[0] / a[1])
        case "neg":
            return -a[0]
        case "abs":
            return np.abs(a[0])
        case "sign":
            return np.sign(a[0])
        case "sqrt":
            return np.where(a[0] >= 0, np.sqrt(a[0]), np.nan)
        case "log":
            return np.where(a[0] > 0, stepped(np.log(a[0])), np.where(a[0] == 0, -np.inf, np.nan))
        case "lt":
            return a[0] < a[1]
        case "le":
            return a[0] <= a[1]
        case "eq":
            return a[0] == a[1]
        case "and":
            return a[0] & a[1]
        case "known":
            return ~np.isnan(a[0])
        case "finite":
            return np.where(np.isfinite(a[0]), a[0], np.nan)
        case "where":
            return np.where(a[0], a[1], a[2])
        case "emax":
            return np.maximum(*a)
        case "emin":
            return np.minimum(*a)
        case "fmax":
            return np.fmax.reduce(a)
        case "fmin":
            return np.fmin.reduce(a)
        case "rank":
            return shares(a[0])
        case "lag":
            return windows(a[0], params[0] + 1)[0]
        case "clip":
            count = (~np.isnan(a[0])).sum(1, keepdims=True)
            mean = np.nansum(a[0], 1, keepdims=True) / count
            dev = np.sqrt(np.nansum((a[0] - mean) ** 2, 1, keepdims=True) / (count - 1))
            return np.where(dev > 0, np.minimum(np.maximum(a[0], mean - 10 * dev), mean + 10 * dev), a[0])
        case "sma":
            return recursive_means(a[0], *params)
    n = params[0]
    if op == "count":
        return sum(windows(a[0], n), 0.0)
    x = [windows(np.where(np.isfinite(v), v, np.nan) if inf else v, n) for v, inf in zip(a, infinite, strict=True)]
    if op in ("corr", "beta"):
        both = [np.isnan(u + v) for u, v in zip(*x, strict=True)]
        u, v = ([np.where(b, np.nan, w) for b, w in zip(both, side, strict=True)] for side in x)
        low, high = least_most(v)
        if op == "beta":
            return np.where(low < high, stepped(comoments(u, v) / (n - 1) / moments(v)), np.nan)
        first, last = least_most(u)
        return np.where((low < high) & (first < last), stepped(comoments(u, v) / n / (np.sqrt(moments(u)) * np.sqrt(moments(v)))), np.nan)
    match op:
        case "tsrank":
            known = ~np.isnan(sum(x[0]))
            return np.where(known, sum((v <= x[0][-1]).astype(float) for v in x[0]) / n, np.nan)
        case "sum":
            return sum(x[0])
        case "std":
            return np.sqrt(moments(x[0]))
        case "max":
            return least_most(x[0])[1]
        case "min":
            return least_most(x[0])[0]
    raise ValueError(op)


#: Windows of more rows than this are computed over whole histories.
LONG = 16
_CLEAN = ("sum", "std", "max", "min", "corr", "beta", "tsrank")
_WINDOWS = ("lag", "count", *_CLEAN)


def reach(op: str, params: tuple) -> float:
    """How many rows before its own a node reads of its arguments."""
    if op in ("sma", "clip"):
        return np.inf
    return params[0] - (op != "lag") if op in _WINDOWS else 0


def frontier(roots: Iterable[Expr]) -> list[Expr]:
    """What slices are computed from: fields, and what looks far back."""
    out, seen = {}, set()

    def visit(x: Expr) -> None:
        if x in seen:
            return
        seen.add(x)
        if x.op == "field" or reach(x.op, x.params) >= LONG:
            if any(y.kind == SECTION for y in nodes([x])):
                raise ValueError("a long window of cross-sections")
            out[x] = None
        else:
            for a in x.args:
                visit(a)

    for x in roots:
        visit(x)
    return list(out)


def sliced(outputs: Sequence[Expr], given: Sequence[Expr]) -> tuple[list[tuple], list[int], list[int], list[int]]:
    """program() of a slice: infinite values leave a window as a step of its own. Besides, of each place, how many rows before the
    slice it is needed at (-1: never), and how many rows back it is read."""
    place, steps = {x: i for i, x in enumerate(given)}, []

    def visit(x: Expr) -> int:
        if x not in place:
            args = tuple(visit(Expr("finite", (a,)) if x.op in _CLEAN and a.may_be_infinite else a) for a in x.args)
            steps.append((x.op, x.params, args))
            place[x] = len(given) + len(steps) - 1
        return place[x]

    places = [visit(x) for x in outputs]
    lead, back = [-1] * (len(given) + len(steps)), [0] * (len(given) + len(steps))
    for i in places:
        lead[i] = 0
    for k in reversed(range(len(steps))):
        op, params, args = steps[k]
        rows = reach(op, params)
        for i in args:
            lead[i], back[i] = max(lead[i], lead[len(given) + k] + rows), max(back[i], rows)
    return steps, places, lead, back


def rolled(plan: tuple, given: Callable[[int], list], first: int, start: int, end: int, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The outputs of a sliced() plan on the rows start, ..., end - 1, one after another; given(row) has the given arrays, None where
    they aren't needed, and no row comes before `first`. Only what later steps and rows read is kept."""
    steps, places, lead, back = plan
    held = len(lead) - len(steps)
    past = [deque(maxlen=b + 1) for b in back]
    last = {i: k for k, (*_, args) in enumerate(steps) for i in args}
    last |= dict.fromkeys(places, len(steps))
    done: list[list[int]] = [[] for _ in range(len(steps) + 1)]
    for i, k in last.items():
        if not back[i]:
            done[k].append(i)
    blank = np.full(n, np.nan)
    window = lambda a, size: [blank] * (size - len(a)) + list(a)[-size:]
    with np.errstate(all="ignore"):
        for row in range(max(first, start - max(lead)), end):
            for i, x in enumerate(given(row)):
                if row >= start - lead[i] and lead[i] >= 0:
                    past[i].append(x)
            for k, (op, params, args) in enumerate(steps):
                if row >= start - lead[held + k]:
                    past[held + k].append(value(op, params, [past[i] if op in _WINDOWS else past[i][-1] for i in args], (False,) * len(args), (n,), window))
                for i in done[k]:
                    past[i].clear()
            if row >= start:
                yield row, [past[i][-1] for i in places]
            for i in done[-1]:
                past[i].clear()


def packed(columns: Sequence[np.ndarray]) -> bytes:
    """Some columns of one length: which values are known, and these."""
    known = [~np.isnan(x) for x in columns]
    data = np.packbits(np.concatenate(known)).tobytes() + b"".join(x[k].tobytes() for x, k in zip(columns, known, strict=True))
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    """The columns as rows of a matrix."""
    raw = pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)
    mask = -(-width * n // 8)
    known = np.unpackbits(np.frombuffer(raw, np.uint8, mask), count=width * n).astype(bool)
    out = np.full(width * n, np.nan)
    out[known] = np.frombuffer(raw[mask:], np.float64)
    return out.reshape(width, n)
