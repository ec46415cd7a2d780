"""Factor expressions as DuckDB SQL, written apart from the planner so that each checks the other."""

from __future__ import annotations

from ..functions.expr import SCALAR, Expr
from .planner import STEPS, nodes

def rounded(x: str) -> str:
    """What the output keeps of a value."""
    grid = lambda k: f"round_even({x} * {float(1 << k)!r}, 0) / {float(1 << k)!r}"
    return f"(CASE WHEN abs({x}) < 10 THEN {grid(27)} WHEN abs({x}) < 1e5 THEN {grid(14)} ELSE round_even({x} / pow(2, floor(log2(abs({x}))) - 30), 0) * pow(2, floor(log2(abs({x}))) - 30) END + 0.0)"


def stepped(x: str) -> str:
    return f"round_even({x} * {STEPS!r}, 0) / {STEPS!r}"


def scalar(x: Expr, names: dict[Expr, str]) -> str:
    if x in names:
        return names[x]
    a = [scalar(y, names) for y in x.args]
    infinite = any(y.may_be_infinite for y in x.args)
    known = lambda s: f"(CASE WHEN NOT isnan({s}) THEN {s} END)" if infinite else f"({s})"
    match x.op:
        case "field":
            return x.params[0]
        case "const":
            return "NULL::DOUBLE" if x.params[0] is None else f"{x.params[0]!r}::DOUBLE"
        case "add" | "sub" | "mul":
            return known(f"{a[0]} {({'add': '+', 'sub': '-', 'mul': '*'})[x.op]} {a[1]}")
        case "div":
            return f"(CASE WHEN {a[1]} = 0 THEN CASE WHEN {a[0]} > 0 THEN 'inf'::DOUBLE WHEN {a[0]} < 0 THEN '-inf'::DOUBLE END ELSE {known(f'{a[0]} / {a[1]}')} END)"
        case "neg":
            return f"(-{a[0]})"
        case "abs":
            return f"abs({a[0]})"
        case "sign":
            return f"sign({a[0]})::DOUBLE"
        case "sqrt":
            return f"(CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END)"
        case "log":
            return f"(CASE WHEN {a[0]} > 0 THEN {stepped(f'ln({a[0]})')} WHEN {a[0]} = 0 THEN '-inf'::DOUBLE END)"
        case "lt" | "le" | "eq":
            return f"coalesce({a[0]} {({'lt': '<', 'le': '<=', 'eq': '='})[x.op]} {a[1]}, false)"
        case "and":
            return f"({a[0]} AND {a[1]})"
        case "known":
            return f"({a[0]} IS NOT NULL)"
        case "finite":
            return f"(CASE WHEN isfinite({a[0]}) THEN {a[0]} END)"
        case "where":
            return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
        case "emax" | "emin":
            return f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN {'greatest' if x.op == 'emax' else 'least'}({a[0]}, {a[1]}) END)"
        case "fmax" | "fmin":
            return f"{'greatest' if x.op == 'fmax' else 'least'}({a[0]}, {a[1]})"
    raise ValueError(x.op)


def windowed(x: Expr, a: list[str]) -> str:
    by = "PARTITION BY symbol ORDER BY date"
    if x.op == "lag":
        return f"lag({a[0]}, {x.params[0]}) OVER ({by})"
    if x.op == "clip":
        m, s = f"avg({a[0]}) OVER (PARTITION BY symbol)", f"stddev_samp({a[0]}) OVER (PARTITION BY symbol)"
        return f"CASE WHEN {a[0]} IS NULL THEN NULL WHEN {s} > 0 THEN least(greatest({a[0]}, {m} - 10 * {s}), {m} + 10 * {s}) ELSE {a[0]} END"
    if x.op == "rank":
        return f"CASE WHEN {a[0]} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {a[0]} NULLS LAST) + (count(*) OVER (PARTITION BY date, {a[0]}) - 1) / 2.0) / count({a[0]}) OVER (PARTITION BY date) END"
    n = x.params[0]
    frame = f"({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if x.op == "count":
        return f"CASE WHEN count(*) OVER {frame} = {n} THEN (sum({a[0]}::INT) OVER {frame})::DOUBLE END"
    if x.op == "sma":
        w = x.params[1] / n
        before = f"list({a[0]}) FILTER ({a[0]} IS NOT NULL) OVER ({by} ROWS UNBOUNDED PRECEDING)"
        first = f"avg({a[0]}) OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN row_number() OVER ({by}) < {n} THEN NULL WHEN row_number() OVER ({by}) = {n} THEN {first} ELSE CASE WHEN len({before}) > 0 THEN list_reduce({before}, lambda acc, v: acc * (1 - {w!r}) + {w!r} * v) END END"
    a = [f"(CASE WHEN isfinite({s}) THEN {s} END)" if y.may_be_infinite else s for s, y in zip(a, x.args, strict=True)]
    if x.op == "tsrank":
        return f"CASE WHEN count({a[0]}) OVER {frame} = {n} THEN ({' + '.join(f'(coalesce(lag({a[0]}, {k}) OVER ({by}) <= {a[0]}, false))::INT' for k in range(n))}) / {n}.0 END"
    if x.op in ("corr", "beta"):
        u, v = (f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN {s} END)" for s in a)
        moves = lambda s: f"min({s}) OVER {frame} < max({s}) OVER {frame}"
        if x.op == "beta":
            return f"CASE WHEN count({u}) OVER {frame} = {n} AND {moves(v)} THEN {stepped(f'(covar_samp({u}, {v}) OVER {frame} / var_pop({v}) OVER {frame})')} END"
        return f"CASE WHEN count({u}) OVER {frame} = {n} AND {moves(u)} AND {moves(v)} THEN {stepped(f'(covar_pop({u}, {v}) OVER {frame} / (stddev_pop({u}) OVER {frame} * stddev_pop({v}) OVER {frame}))')} END"
    f = {"sum": "sum", "std": "stddev_pop", "max": "max", "min": "min"}[x.op]
    return f"CASE WHEN count({a[0]}) OVER {frame} = {n} THEN {f}({a[0]}) OVER {frame} END"


def factor_ctes(roots: dict[str, Expr], source: str, name: str = "factors") -> str:
    """CTEs from a table `source` (symbol, date, fields) to `name` (symbol, date, one column per root)."""
    names: dict[Expr, str] = {}
    out, last, left = [], source, [x for x in nodes(roots.values()) if x.kind != SCALAR]
    while left:
        batch = [x for x in left if all(y in names for y in nodes(x.args) if y.kind != SCALAR)]
        new = {x: f"n{len(names) + i}" for i, x in enumerate(batch)}
        out.append(f"{name}_{len(out)} AS MATERIALIZED (SELECT *, {', '.join(f'{windowed(x, [scalar(y, names) for y in x.args])} AS {n}' for x, n in new.items())} FROM {last})")
        last = f"{name}_{len(out) - 1}"
        names |= new
        left = [x for x in left if x not in names]
    out.append(f"{name} AS (SELECT symbol, date, {', '.join(f'({scalar(x, names)})::DOUBLE AS {n}' for n, x in roots.items())} FROM {last})")
    return ",\n".join(out)
