"""Factor expressions: small immutable trees that the planner turns into staged DataFrame columns.

A value is null, finite or infinite, never NaN. Comparisons with null are false.
"""

from __future__ import annotations

from dataclasses import dataclass

#: What a node needs together: nothing, its symbol's history, or its date's cross-section.
SCALAR, SERIES, SECTION = "scalar", "series", "section"
_SERIES = {"lag", "sum", "std", "max", "min", "count", "corr", "sma", "tsrank", "beta", "clip"}


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple[Expr, ...] = ()
    params: tuple = ()

    @property
    def kind(self) -> str:
        return SERIES if self.op in _SERIES else SECTION if self.op == "rank" else SCALAR

    @property
    def may_be_infinite(self) -> bool:
        """Whether the value can be infinite by its operators."""
        if self.op in ("log", "div"):
            return True
        return self.op in ("add", "sub", "mul", "neg", "abs", "lag", "where", "emax", "emin", "fmax", "fmin") and any(a.may_be_infinite for a in self.args)

    def __add__(self, o):
        return Expr("add", (self, wrap(o)))

    def __radd__(self, o):
        return Expr("add", (wrap(o), self))

    def __sub__(self, o):
        return Expr("sub", (self, wrap(o)))

    def __rsub__(self, o):
        return Expr("sub", (wrap(o), self))

    def __mul__(self, o):
        return Expr("mul", (self, wrap(o)))

    def __rmul__(self, o):
        return Expr("mul", (wrap(o), self))

    def __truediv__(self, o):
        return Expr("div", (self, wrap(o)))

    def __rtruediv__(self, o):
        return Expr("div", (wrap(o), self))

    def __neg__(self):
        return Expr("neg", (self,))

    def __lt__(self, o):
        return Expr("lt", (self, wrap(o)))

    def __gt__(self, o):
        return Expr("lt", (wrap(o), self))

    def __le__(self, o):
        return Expr("le", (self, wrap(o)))

    def __ge__(self, o):
        return Expr("le", (wrap(o), self))

    def __and__(self, o):
        return Expr("and", (self, o))

    def equals(self, o):
        return Expr("eq", (self, wrap(o)))


def wrap(x: Expr | float | None) -> Expr:
    return x if isinstance(x, Expr) else Expr("const", (), (None if x is None else float(x),))


def field(name: str) -> Expr:
    return Expr("field", (), (name,))


def call(op: str, *args, params: tuple = ()) -> Expr:
    return Expr(op, tuple(wrap(a) for a in args), params)


def DELAY(x, n):
    """The value n rows before."""
    return call("lag", x, params=(n,))


def DELTA(x, n):
    return wrap(x) - DELAY(x, n)


def SUM(x, n):
    """Over the last n rows; null unless all are known."""
    return call("sum", x, params=(n,))


def STD(x, n):
    """Population deviation over the last n rows."""
    return call("std", x, params=(n,))


def MAX(x, n):
    return call("max", x, params=(n,))


def MIN(x, n):
    return call("min", x, params=(n,))


def RANK(x):
    """Share of the date's known values, ties by their mean rank."""
    return call("rank", x)


def TSRANK(x, n):
    """Share of the last n values that are no larger than the current one."""
    return call("tsrank", x, params=(n,))


def CORR(a, b, n):
    """Pearson correlation over the last n rows; null for a constant window."""
    return call("corr", a, b, params=(n,))


def SMA(x, n, m):
    """Recursive mean with weight m / n, seeded by the first value; row n is the plain mean of the first n."""
    return call("sma", x, params=(n, m))


def REGBETA(y, x, n):
    """Sample covariance over population variance, as the factors are defined."""
    return call("beta", y, x, params=(n,))


def REGRESI(y, x, n):
    """y less beta times x, without intercept."""
    return wrap(y) - REGBETA(y, x, n) * wrap(x)


def COUNT(condition, n):
    """Rows of the last n for which the condition holds; an unknown one does not."""
    return call("count", condition, params=(n,))


def LOG(x):
    """Natural logarithm: minus infinity at 0, null below."""
    return call("log", x)


def ABS(x):
    return call("abs", x)


def SIGN(x):
    return call("sign", x)


def SQRT(x):
    return call("sqrt", x)


def WHERE(condition, x, y):
    return call("where", condition, x, y)


def EMAX(a, b):
    """Larger of two, null if either is."""
    return call("emax", a, b)


def EMIN(a, b):
    return call("emin", a, b)


def FMAX(a, b):
    """Larger of those known."""
    return call("fmax", a, b)


def FMIN(a, b):
    return call("fmin", a, b)


def FINITE(x):
    return call("finite", x)


def KNOWN(x):
    return call("known", x)


def CLIP(x):
    """Within ten sample deviations of the symbol's mean over its whole history."""
    return call("clip", FINITE(x))
