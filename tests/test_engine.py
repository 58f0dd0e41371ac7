"""Indicators, sources and the engine on small bars, against the interpreter's machines and literal results."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import collections as A
from barloom.functions import linalg
from barloom.functions import scalars as X
from barloom.operators import cross
from barloom.operators import scans as S
from barloom.operators import windows as T
from barloom.plans.engine import Engine
from barloom.plans.interpreter import Interpreter
from barloom.plans.syntax import ScriptError, compile_script
from barloom.sources.bars import Catalog


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for s, k in (("A", 3), ("B", 5)):
        for i in range(40):
            c = 50 + (i * k) % 11 + i * 0.25
            rows.append((s, i, c - 1, c + 2 + i % 3, c - 2 - i % 2, c, float(100 + (i * k) % 13)))
    return spark.createDataFrame(rows, "symbol string, bar_index long, open double, high double, low double, close double, volume double").cache()


C, H, L, V = (lambda: F.col("close")), (lambda: F.col("high")), (lambda: F.col("low")), (lambda: F.col("volume"))
PAIRS = [
    ("ta.sma(close,5)", lambda: T.sma(C(), 5)), ("ta.wma(close,5)", lambda: T.wma(C(), 5)), ("ta.wma(close,35)", lambda: T.wma(C(), 35)), ("ta.swma(close)", lambda: T.swma(C())),
    ("ta.hma(close,9)", lambda: T.hma(C(), 9)), ("ta.alma(close,9,0.85,6)", lambda: T.alma(C(), 9)), ("ta.linreg(close,7,1)", lambda: T.linreg(C(), 7, 1)), ("ta.vwma(close,5)", lambda: T.vwma(C(), V(), 5)),
    ("ta.rsi(close,6)", lambda: T.rsi(C(), 6)), ("ta.cci(close,6)", lambda: T.cci(C(), 6)), ("ta.cmo(close,6)", lambda: T.cmo(C(), 6)), ("ta.cog(close,6)", lambda: T.cog(C(), 6)), ("ta.mom(close,3)", lambda: T.mom(C(), 3)),
    ("ta.roc(close,3)", lambda: T.roc(C(), 3)), ("ta.stoch(close,high,low,5)", lambda: T.stoch(C(), H(), L(), 5)), ("ta.mfi(close,5)", lambda: T.mfi(C(), V(), 5)), ("ta.wpr(5)", lambda: T.wpr(H(), L(), C(), 5)),
    ("ta.tr()", lambda: T.tr(H(), L(), C())), ("ta.bbw(close,5,2)", lambda: T.bbw(C(), 5, 2.0)), ("ta.stdev(close,5,false)", lambda: T.stdev(C(), 5, False)), ("ta.variance(close,5)", lambda: T.variance(C(), 5)),
    ("ta.dev(close,5)", lambda: T.dev(C(), 5)), ("ta.correlation(close,volume,6)", lambda: T.correlation(C(), V(), 6)), ("ta.highest(close,5)", lambda: T.highest(C(), 5)), ("ta.lowestbars(5)", lambda: T.lowestbars(L(), 5)),
    ("ta.highestbars(5)", lambda: T.highestbars(H(), 5)), ("ta.max(close)", lambda: T.run_max(C())), ("ta.median(close,4)", lambda: T.median(C(), 4)), ("ta.mode(volume,6)", lambda: T.mode(V(), 6)),
    ("ta.percentile_linear_interpolation(close,6,30)", lambda: T.pct_linear(C(), 6, 30)), ("ta.percentile_nearest_rank(close,6,30)", lambda: T.pct_nearest(C(), 6, 30)), ("ta.percentrank(close,6)", lambda: T.percentrank(C(), 6)),
    ("ta.rising(close,3)", lambda: T.rising(C(), 3).cast("double")), ("ta.falling(close,3)", lambda: T.falling(C(), 3).cast("double")), ("ta.pivothigh(2,2)", lambda: T.pivothigh(H(), 2, 2)), ("ta.pivotlow(2,2)", lambda: T.pivotlow(L(), 2, 2)),
    ("ta.crossover(close,ta.sma(close,5))", lambda: T.crossover(C(), T.sma(C(), 5)).cast("double")), ("ta.crossunder(close,ta.sma(close,5))", lambda: T.crossunder(C(), T.sma(C(), 5)).cast("double")),
    ("ta.barssince(close>55)", lambda: T.barssince(C() > 55)), ("ta.cum(volume)", lambda: T.cum(V())), ("ta.valuewhen(close>55,volume,1)", lambda: T.valuewhen(C() > 55, V(), 1)), ("close[3]", lambda: T.lag(C(), 3)),
]


def test_windows_equal_machines(spark, bars):
    out = bars.select("symbol", "bar_index", *(f().alias(f"c{i}") for i, (_, f) in enumerate(PAIRS))).where("symbol = 'B'").orderBy("bar_index").collect()
    data = {c: [r[c] for r in bars.where("symbol = 'B'").orderBy("bar_index").collect()] for c in ("open", "high", "low", "close", "volume")}
    for i, (text, _) in enumerate(PAIRS):
        expected = Interpreter(compile_script(text), data).run()
        for r, e in zip(out, expected, strict=True):
            v = r[f"c{i}"]
            assert (v is None) == (e is None) and (v is None or abs(v - e) < 1e-7), (text, r.bar_index, v, e)


def test_one_exchange_serves_windows_and_scans(bars):
    df = bars.select("symbol", "bar_index", T.sma(C(), 5).alias("a"), T.stdev(C(), 9).alias("b"), T.hma(C(), 9).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fold_equals_scan(bars):
    both = S.scan(bars, S.ema("close", 5, "e"), S.rma("close", 5, "r"))
    for kind, name in (("ema", "e"), ("rma", "r")):
        fold = S.affine(bars, F.col("close"), 5, kind, "v")
        assert both.join(fold, ["symbol", "bar_index"]).where(F.abs(F.col("v") - F.col(name)) > 1e-9).count() == 0
        assert fold.where("v is null").count() == 8


def test_na_poisons_recursion(spark):
    rows = spark.createDataFrame([("A", 0, 1.0), ("A", 1, None), ("A", 2, 3.0), ("A", 3, 4.0)], "symbol string, bar_index long, close double")
    assert [r.v for r in S.scan(rows, S.ema("close", 2, "v")).orderBy("bar_index").collect()] == [None] * 4
    assert [r.v for r in rows.select("bar_index", T.sma(F.col("close"), 2).alias("v")).orderBy("bar_index").collect()] == [None, None, None, 3.5]


def test_catalog_first_source_wins(spark, bars):
    other = spark.createDataFrame([("A", 0, -1.0), ("C", 0, 7.0)], "symbol string, bar_index long, close double")
    got = Catalog().add(bars).add(other)
    assert [r.symbol for r in got.symbols().collect()] == ["A", "B", "C"]
    assert got.bars().where("symbol = 'A' and close < 0").count() == 0
    assert got.value_types() == ["close", "high", "low", "open", "volume"]
    with pytest.raises(ValueError):
        Catalog().bars()


def test_engine(spark, bars):
    e = Engine().register_source(bars).register_function("half", lambda x: x / 2)
    code = e.compile("x = half(close) + close_of('A')\nalertcondition(close > 60, 'hot', 'hot')\nx")
    got = e.execute(code)
    last = {r.symbol: r.value for r in got.last().collect()}
    close = {r.symbol: r.close for r in bars.where("bar_index = 39").collect()}
    assert last["B"] == pytest.approx(close["B"] / 2 + close["A"])
    assert got.alerts().count() == bars.where("close > 60").count()
    assert {r.name for r in got.variables().collect()} == {"x"}
    with pytest.raises(ScriptError):
        e.execute(e.compile("close_of('nope')"))
    for bad in (("1x", None), ("f", ["a", "a"]), ("f", ["a", "b", "c"])):
        with pytest.raises(ValueError):
            e.register_function(bad[0], lambda a: a, bad[1])
    with pytest.raises(ValueError):
        Engine(default_value_type="nope").register_source(bars).execute(code)


def test_cross_symbols(bars):
    assert cross.close_of(bars, "A").where("symbol = 'B' and close_of is null").count() == 0
    assert cross.sma_of(bars, "A", 5).select("sma_of").distinct().count() == 1
    assert cross.value_of(bars, "A", "missing", "v").where("symbol = 'A' and v <> close").count() == 0


def test_linear_algebra():
    import numpy as np

    assert linalg.det(np.array([[1.0, 2], [2, 4]])) == 0
    assert linalg.rank(np.array([[1.0, 2, 3], [2, 4, 6]])) == 1
    assert np.allclose(linalg.pinv(np.array([[1.0, 0], [0, 2], [0, 0]])), [[1, 0, 0], [0, 0.5, 0]])
    # The sums and the quotient of matrix_inverses' SQL, to the last bit: this row stands 1e-12 from a half at 9 digits.
    x1, x2, x3 = 14.18, 33.14, 81.6
    xx, sy = x1 * x1 + x2 * x2 + x3 * x3, x1 + 2 * x2 + 5 * x3
    det = 30 * xx - sy * sy
    got = linalg.pinv(np.array([[x1, 1], [x2, 2], [x3, 5]]))
    assert got[:, 0].tolist() == [(30 * x1 - sy) / det, (xx - sy * x1) / det]
    assert round(float(got[1, 0]), 9) == 7.183931293
    wide = np.array([[1.0, 2, 3, 5], [0, 1, 4, 4], [2, 0, 1, 7]])
    for a in (wide, wide.T, wide[:2], wide[:, :2]):
        assert np.allclose(linalg.pinv(a), np.linalg.pinv(a))
    assert np.allclose(linalg.eigen(np.diag([1.0, 2, 4]))[0], [4, 2, 1])
    with pytest.raises(ValueError):
        linalg.inv(np.array([[1.0, 2], [2, 4]]))


def test_text_and_time(spark):
    values = [3.0, -2.5, 0.1, 1e6, 123456.0, 1e-5, None, 1234567.0, 0.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(X.to_text(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == ["3", "-2.5", "0.1", "1e+06", "123456", "1e-05", "na", "1.234567e+06", "0", "100"]
    assert X.in_seconds("5m") == 5 * 2592000 and X.in_seconds("2H") == 7200 and X.in_seconds("30") == 1800 and X.in_seconds("10T") is None
    assert X.from_seconds(86400) == "1D" and X.from_seconds(90) == "90S" and X.from_seconds(120) == "2"
    assert X.timestamp(2024, 14, 1) == X.timestamp(2025, 2, 1)


def test_text_of_numbers_with_exponents(spark):
    texts = {
        1e100: "1e+100", -2.5e-120: "-2.5e-120", float("inf"): "+Inf", float("-inf"): "-Inf", float("nan"): "na", 999999.5: "999999.5", -1000000.5: "-1.0000005e+06", 9999999.0: "9.999999e+06",
        1e7: "1e+07", -1.25e10: "-1.25e+10", 0.001: "0.001", -0.00015: "-0.00015", 1e-4: "0.0001", 9.5e-5: "9.5e-05", -1e-9: "-1e-09", 1e-10: "1e-10",
    }
    df = spark.createDataFrame([(v,) for v in texts], "v double").select(X.to_text(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == list(texts.values())


def test_text_names_its_number_once(spark):
    """Else the code of one select outgrows what the JVM compiles, and every row is interpreted."""
    wide = spark.range(3).select(*(X.to_text(F.col("id") * 7919 + i).alias(f"t{i}") for i in range(4)))
    run = wide._jdf.queryExecution()
    assert run.optimizedPlan().toString().count("7919") == 4
    stages = run.debug().codegenToSeq()
    assert all(0 < stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))
    assert [r.t3 for r in wide.collect()] == ["3", "7922", "15841"]


def test_array_errors(spark):
    row = spark.createDataFrame([([1.0, 2.0],)], "a array<double>")
    with pytest.raises(Exception, match="out of range"):
        row.select(A.get(F.col("a"), 5)).collect()
    assert row.select(A.max_(F.col("a"), 5)).first()[0] is None
