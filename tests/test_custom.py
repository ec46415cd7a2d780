"""Formula text gives the library's own expressions; wrong text is refused with its place."""

import re

import pytest

from factorlab.functions.alphas import PANEL, SPARSE, definitions
from factorlab.functions.custom import FormulaError, factor, parsed

SAME = {
    "alpha001": "-CORR(RANK(DELTA(LOG(V), 1)), RANK((C - O) / O), 6)",
    "alpha002": "-DELTA(((C - L) - (H - C)) / (H - L), 1)",
    "alpha003": "SUM(WHERE(C == DELAY(C, 1), 0, WHERE(C > DELAY(C, 1), C - EMIN(L, DELAY(C, 1)), C - EMAX(H, DELAY(C, 1)))), 6)",
    "alpha013": "SQRT(high * low) - vwap",
    "alpha055": "-RANK(ABS(DELTA(close, 4))) * RANK(DELTA(volume, 4))",
}


@pytest.mark.parametrize("name", SAME)
def test_text_gives_the_library_expression(name):
    got = factor(name, SAME[name])
    assert got == definitions()[name]
    assert got.calendar == (PANEL if "RANK" in SAME[name] else SPARSE)


def test_parameters():
    text = "-RANK(ABS(DELTA(C, days))) * RANK(DELTA(V, days))"
    assert parsed(text, days=10) == definitions(10)["alpha055"].expr
    assert parsed("SUM(C, 2 * n) / (2 * n)", n=4) == parsed("SUM(C, 8) / 8")
    assert parsed("WHERE((C > O) & (V >= 2), -1.5, C)").op == "where"
    assert parsed("SMA(C, 7, 2)") != parsed("SMA(C, 7, 1)")


@pytest.mark.parametrize(("text", "why"), [
    ("C +", "invalid syntax"), ("CLOSE", "unknown name"), ("__import__('os')", "can't be part"), ("C.real", "can't be part"), ("SUM(C)", "takes 2 arguments"), ("SUM(C, 0)", "number of rows"), ("SUM(C, 2.5)", "number of rows"),
    ("SUM(C, V)", "number of rows"), ("WHERE(C, 1, 2)", "condition is needed"), ("C > O", "value is needed"), ("(C > O) + 1", "value is needed"), ("RANK(C, n=3)", "can't be part"), ("SMA(C, 2, 3)", "must not exceed"),
    ("1 / 0", "division by zero"), ("C if V else O", "can't be part"), ("'x'", "can't be part"), ("C ** 2", "can't be part"), ("O < C < H", "can't be part"), ("C & V", "condition is needed"),
])
def test_wrong_text_is_refused(text, why):
    with pytest.raises(FormulaError, match=why):
        parsed(text)


def test_wrong_parameters_are_refused():
    for params in ({"C": 3}, {"days": True}, {"days": "3"}, {"unused": 1}):
        with pytest.raises(FormulaError):
            parsed("SUM(C, 3)", **params)


def test_stored_bars_prune_and_fetch(spark, tmp_path):
    import datetime as dt

    from factorlab.sources import bars as B

    day = lambda y, k: dt.date(y, 1, 1) + dt.timedelta(7 * k)
    row = lambda s, d: (s, d, 1.0, 2.0, 0.5, 1.5, 10.0, 15.0)
    source = spark.createDataFrame([row(s, day(y, k)) for s in ("000001", "000002", "600000", "600001", "600002") for y in (2019, 2020, 2021, 2022) for k in range(4)], B.SCHEMA)
    old = source.where("symbol IN ('000001', '000002') AND date >= '2020-01-08' AND date <= '2021-12-31' OR symbol = '600002' AND date >= '2019-01-01'")
    B.write(old, str(tmp_path / "bars"))
    got = B.stored(spark, str(tmp_path / "bars"), "2020-06-01", "2021-01-10", ["000001"])
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ >= 2020", plan) and re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(symbol", plan) and re.search(r"PushedFilters: \[[^\]]*date", plan)
    assert sorted((r.symbol, r.date) for r in got.collect()) == [("000001", day(2021, 0)), ("000001", day(2021, 1))]
    wanted = source.select("symbol")
    new = B.fetched(B.stored(spark, str(tmp_path / "bars")), source, wanted, "2019-01-01", "2022-01-08", 1)
    want = {(s, day(y, k)) for s in ("000001", "000002") for y, ks in ((2019, range(4)), (2020, (0,)), (2022, (0, 1))) for k in ks} | {("600000", day(y, k)) for y in (2019, 2020, 2021) for k in range(4)} | {("600000", day(2022, k)) for k in (0, 1)}
    assert {(r.symbol, r.date) for r in new.collect()} == want
    assert B.fetched(old, source, wanted, "2019-01-01", "2022-01-08").select("symbol").distinct().count() == 4
    assert B.fetched(old, source, wanted.limit(0), "2019-01-01", "2022-01-08").count() == 0
