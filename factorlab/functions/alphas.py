"""The 191 formulaic factors as expressions, with the calendar each is computed on."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from .expr import ABS, CLIP, CORR, COUNT, DELAY, DELTA, EMAX, EMIN, FINITE, FMAX, FMIN, KNOWN, LOG, MAX, MIN, RANK, REGBETA, REGRESI, SIGN, SMA, SQRT, STD, SUM, TSRANK, WHERE, Expr, field

#: Sparse: a symbol's own rows. Panel: every symbol on every date of the calendar.
SPARSE, PANEL = "sparse", "panel"


@dataclass(frozen=True)
class Factor:
    name: str
    calendar: str
    expr: Expr


def definitions(delta_days: int = 4) -> dict[str, Factor]:
    """All factors by name. delta_days is the parameter of alpha055."""
    O, H, L, C, V, VW = map(field, ("open", "high", "low", "close", "volume", "vwap"))  # noqa: E741, N806
    prices = (C, H, L, VW)
    found: dict[int, Expr] = {}
    pc = DELAY(C, 1)
    up, down = DELTA(C, 1), DELTA(C, 2)
    middle = (H + L) / 2
    ret = C / pc - 1
    place = ((C - L) - (H - C)) / (H - L)  # where the close lies in the day's range

    found[1] = -CORR(RANK(DELTA(LOG(V), 1)), RANK((C - O) / O), 6)
    found[2] = -DELTA(place, 1)
    found[3] = SUM(WHERE(C.equals(pc), 0.0, WHERE(C > pc, C - EMIN(L, pc), C - EMAX(H, pc))), 6)
    mean8, mean2, std8 = SUM(C, 8) / 8, SUM(C, 2) / 2, STD(C, 8)
    found[4] = WHERE(mean8 + std8 < mean2, -1.0, WHERE(mean2 < mean8 - std8, 1.0, WHERE(V / (SUM(V, 20) / 20) >= 1.0, 1.0, -1.0)))
    found[5], found[6] = -TSRANK(EMAX(up, 0.0), 5), -TSRANK(EMIN(up, 0.0), 5)
    found[7] = (RANK(MAX(VW - C, 3)) + RANK(MIN(VW - C, 3))) * RANK(DELTA(V, 3))
    found[8] = RANK(-DELTA(0.2 * middle + 0.8 * VW, 4))
    found[9] = SMA((middle - (DELAY(H, 1) + DELAY(L, 1)) / 2) * (H - L) / V, 7, 2)
    base = WHERE(ret < 0.0, STD(ret, 20), C)
    found[10] = RANK(EMAX(base * base, 5.0))
    found[11] = SUM(place * V, 6)
    found[12] = RANK(O - SUM(VW, 10) / 10) * -RANK(ABS(C - VW))
    found[13] = SQRT(H * L) - VW
    found[14] = DELTA(C, 5)
    found[15] = O / pc - 1
    found[16] = -CORR(RANK(V), RANK(C), 6)
    found[17] = -RANK(DELTA(O, 1) * DELTA(O, 1) + up * up)
    found[18] = -RANK(DELTA(V, 1)) * RANK(ABS(up))
    found[19] = -RANK(MAX(EMAX(ABS(up), ABS(down)), 5))
    found[20] = -RANK(MIN(EMIN(ABS(up), ABS(down)), 5))
    found |= {21 + k: -CORR(RANK(V), RANK(x), 6) for k, x in enumerate((H, L, VW))}
    found |= {23 + n: -RANK(DELTA((C - O) / (H - L), n)) for n in range(1, 6)}
    found |= {29 + k: -TSRANK(CORR(RANK(V), RANK(x), 6), 5) for k, x in enumerate(prices)}
    for n in range(1, 6):
        found[31 + 2 * n], found[32 + 2 * n] = -RANK(EMAX(DELTA(V, n), 0.0)), -RANK(EMIN(DELTA(V, n), 0.0))
        found[46 + n] = -RANK(DELTA(C, n)) * RANK(V)
        days = delta_days if n == 4 else n
        found[51 + n] = -RANK(ABS(DELTA(C, days))) * RANK(DELTA(V, days))
    found |= {43 + k: -CORR(RANK(LOG(DELTA(V, 1))), RANK(DELTA(LOG(x), 1)), 6) for k, x in enumerate(prices)}
    found |= {57 + k: -TSRANK(RANK(x), 5) for k, x in enumerate((*prices, V))}
    found |= {62 + k: -RANK(DELTA(C, i)) * RANK(DELTA(C, j)) for k, (i, j) in enumerate(combinations(range(1, 6), 2))}
    found |= {72 + k: -CORR(RANK(x), RANK(V), 6) for k, x in enumerate(prices)}
    for k, (x, n) in enumerate((x, n) for x in (C, V) for n in (5, 10, 20)):
        smooth = SMA(x, n, 1)
        found[76 + k], found[82 + k], found[88 + k] = -RANK(smooth), -RANK(DELTA(smooth, 1)), -TSRANK(smooth, 5)
    spreads = (C - O, H - L, VW - O, VW - C, H - VW, VW - L)
    for k, part in enumerate(f(x, 0.0) for x in spreads for f in (EMAX, EMIN)):
        found[94 + k] = -RANK(part)
        found[106 + k] = -CORR(RANK(part), RANK(V), 6)
        found[118 + k] = -RANK(DELTA(part, 1))
        found[130 + k] = -TSRANK(part, 5)
    dv = DELTA(LOG(V), 1)
    for k, x in enumerate(prices):
        found[142 + 2 * k], found[143 + 2 * k] = -RANK(REGBETA(DELTA(LOG(x), 1), dv, 5)), -RANK(REGRESI(DELTA(LOG(x), 1), dv, 5))
    for k, x in enumerate((*prices, V)):
        ups, downs = COUNT(x > DELAY(x, 1), 5), COUNT(x < DELAY(x, 1), 5)
        found[150 + 2 * k], found[151 + 2 * k] = -RANK(ups), -RANK(downs)
        found[160 + 2 * k] = -CORR(RANK(ups), RANK(V if k < 4 else C), 6)
        found[161 + 2 * k] = -CORR(RANK(downs), RANK(V if k < 4 else C), 6)
    found[170] = -CORR(RANK(COUNT(V > DELAY(V, 1), 5)), RANK(H), 6)

    o5, c5 = O * O * O * O * O, C * C * C * C * C
    found[171] = CLIP(-((L - C) * o5) / ((C - H + 1e-7) * c5))
    true_range = FMAX(FMAX(H - L, ABS(H - pc)), ABS(L - pc))
    rise, fall = DELTA(H, 1), DELAY(L, 1) - L
    total = SUM(true_range, 14) + 1e-7
    p1 = SUM(WHERE((fall > 0.0) & (fall > rise), fall, 0.0), 14) * 100.0 / total
    p2 = SUM(WHERE((rise > 0.0) & (rise > fall), rise, 0.0), 14) * 100.0 / total
    found[172] = CLIP(SUM(ABS(p1 - p2) / (p1 + p2 + 1e-7) * 100.0, 6) / 6)
    smooth = SMA(C, 13, 2)
    found[173] = CLIP(3.0 * smooth - 2.0 * SMA(smooth, 13, 2) + SMA(SMA(LOG(C), 13, 2), 13, 2))
    std20 = STD(C, 20)
    known = KNOWN(pc) & KNOWN(std20)
    found[174] = CLIP(SMA(WHERE(known & (C > pc), std20, WHERE(known, 0.0, None)), 20, 1))
    found[175] = SUM(true_range, 6) / 6
    bull, bear = FINITE((C - L) / (H - C)), FINITE((H - C) / (C - L))
    found[176] = CLIP(-bear * (C / O))
    high, low = FMAX(bull, bear), FMIN(bull, bear)
    found[177], found[178], found[179], found[180] = -RANK(DELTA(bull, 1)), -RANK(DELTA(bear, 1)), -TSRANK(bull, 5), -TSRANK(bear, 5)
    for k, x in enumerate((high, low)):
        found[181 + k], found[187 + k], found[189 + k] = -RANK(x), -RANK(DELTA(x, 1)), -TSRANK(x, 5)
    found |= {183 + k: -CORR(RANK(x), RANK(V), 6) for k, x in enumerate((bull, bear, high, low))}
    found[191] = -CORR(RANK(high), RANK(dv), 6)

    sparse = {2, 3, 4, 9, 11, 13, 14, 15, *range(171, 177)}
    return {f"alpha{i:03d}": Factor(f"alpha{i:03d}", SPARSE if i in sparse else PANEL, found[i]) for i in sorted(found)}


def operators() -> dict[str, Factor]:
    """One factor per operator of the expression language, on a symbol's own rows (ranks on the panel)."""
    C, V, H, L, O = map(field, ("close", "volume", "high", "low", "open"))  # noqa: E741, N806
    plain = {
        "op_sum": SUM(C, 6), "op_std": STD(C, 8), "op_max": MAX(H, 5), "op_min": MIN(L, 5), "op_delta": DELTA(C, 3), "op_delay": DELAY(C, 2), "op_sma": SMA(C, 13, 2),
        "op_regbeta": REGBETA(DELTA(LOG(C), 1), DELTA(LOG(V), 1), 5), "op_regresi": REGRESI(DELTA(LOG(C), 1), DELTA(LOG(V), 1), 5), "op_count": COUNT(C > DELAY(C, 1), 5),
        "op_log": LOG(DELTA(V, 1)), "op_abs": ABS(DELTA(C, 1)), "op_sign": SIGN(DELTA(C, 1)), "op_corr": CORR(C, V, 6), "op_tsrank": TSRANK(C, 5), "op_sqrt": SQRT(H * L),
        "op_where": WHERE(C > O, C - O, 0.0), "op_emax": EMAX(DELTA(C, 1), 0.0), "op_emin": EMIN(DELTA(C, 1), 0.0), "op_fmax": FMAX(H - L, ABS(H - DELAY(C, 1))), "op_fmin": FMIN(H - L, ABS(H - DELAY(C, 1))), "op_clip": CLIP(C / O),
    }
    return {k: Factor(k, SPARSE, x) for k, x in plain.items()} | {"op_rank": Factor("op_rank", PANEL, RANK(C))}
