"""A user's own factors: the text of a formula as an expression, with named parameters.

The text is read by Python's own syntax tree and only calls the operators of the factor language, so a formula can
neither reach other names nor run code.
"""

from __future__ import annotations

import ast

from . import expr as X
from .alphas import PANEL, SPARSE, Factor

#: Fields that a formula may name, and operators with the kinds of their arguments: an expression or a number of rows.
FIELDS = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "amount": "amount", "vwap": "vwap", "O": "open", "H": "high", "L": "low", "C": "close", "V": "volume", "VW": "vwap"}
OPERATORS = {
    "DELAY": "xn", "DELTA": "xn", "SUM": "xn", "STD": "xn", "MAX": "xn", "MIN": "xn", "TSRANK": "xn", "COUNT": "xn", "SMA": "xnn", "CORR": "xxn", "REGBETA": "xxn", "REGRESI": "xxn",
    "RANK": "x", "LOG": "x", "ABS": "x", "SIGN": "x", "SQRT": "x", "FINITE": "x", "KNOWN": "x", "CLIP": "x", "WHERE": "xxx", "EMAX": "xx", "EMIN": "xx", "FMAX": "xx", "FMIN": "xx",
}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.BitAnd: lambda a, b: a & b}
_COMPARED = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a.equals(b)}
#: Conditions: what WHERE's first and COUNT's argument must be, and what & joins.
_CONDITIONS = {"lt", "le", "eq", "and", "known"}


class FormulaError(ValueError):
    """A formula that can't be read, with the place in its text."""


def parsed(text: str, **params: float) -> X.Expr:
    """The expression of a formula such as -RANK(ABS(DELTA(C, days))) * RANK(DELTA(V, days)), with values for its parameters."""
    for name, value in params.items():
        if name in FIELDS or name in OPERATORS or isinstance(value, bool) or not isinstance(value, (int, float)):
            raise FormulaError(f"parameter {name!r} must be a number and not the name of a field or operator")
    used: set[str] = set()

    def fail(node: ast.AST, why: str) -> FormulaError:
        return FormulaError(f"{why} at column {getattr(node, 'col_offset', 0) + 1} of {text!r}")

    def number(node: ast.AST) -> float | None:
        """The value of a constant part, None if it isn't one."""
        match node:
            case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
                return v
            case ast.Name(id=name) if name in params:
                used.add(name)
                return params[name]
            case ast.UnaryOp(op=ast.USub(), operand=inner) if (v := number(inner)) is not None:
                return -v
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY and not isinstance(op, ast.BitAnd) and (p := number(a)) is not None and (q := number(b)) is not None:
                if isinstance(op, ast.Div) and q == 0:
                    raise fail(node, "division by zero")
                return _BINARY[type(op)](p, q)
        return None

    def rows(node: ast.AST) -> int:
        n = number(node)
        if n is None or n != int(n) or n < 1:
            raise fail(node, "a number of rows must be a whole number from 1 on")
        return int(n)

    def value(node: ast.AST) -> X.Expr:
        x = read(node)
        if x.op in _CONDITIONS:
            raise fail(node, "a condition stands where a value is needed")
        return x

    def condition(node: ast.AST) -> X.Expr:
        x = read(node)
        if x.op not in _CONDITIONS:
            raise fail(node, "a value stands where a condition is needed")
        return x

    def read(node: ast.AST) -> X.Expr:
        if (v := number(node)) is not None:
            return X.wrap(v)
        match node:
            case ast.Name(id=name) if name in FIELDS:
                return X.field(FIELDS[name])
            case ast.Name(id=name):
                raise fail(node, f"unknown name {name!r}")
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -value(inner)
            case ast.BinOp(left=a, op=ast.BitAnd(), right=b):
                return condition(a) & condition(b)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](value(a), value(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARED:
                return _COMPARED[type(op)](value(a), value(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in OPERATORS:
                kinds = OPERATORS[name]
                if len(args) != len(kinds):
                    raise fail(node, f"{name} takes {len(kinds)} arguments, not {len(args)}")
                own = [rows(a) if k == "n" else condition(a) if i == 0 and name in ("WHERE", "COUNT") else value(a) for i, (k, a) in enumerate(zip(kinds, args, strict=True))]
                if name == "SMA" and own[2] > own[1]:
                    raise fail(node, "the weight of SMA must not exceed its length")
                return getattr(X, name)(*own)
        raise fail(node, "this can't be part of a formula")

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError) as e:
        raise FormulaError(f"{e} in {text!r}") from None
    out = value(tree.body)
    if unused := sorted(set(params) - used):
        raise FormulaError(f"parameters without use: {', '.join(unused)}")
    return out


def factor(name: str, text: str, calendar: str | None = None, **params: float) -> Factor:
    """A named factor. With a rank across symbols it is computed on the panel, else on a symbol's own rows."""
    out = parsed(text, **params)

    def ranked(x: X.Expr) -> bool:
        return x.op == "rank" or any(map(ranked, x.args))

    return Factor(name, calendar or (PANEL if ranked(out) else SPARSE), out)
