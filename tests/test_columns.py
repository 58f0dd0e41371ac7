"""Straight-line scripts as columns give what the interpreter gives; rolling forms give what machines give."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import kernels as K
from barloom.operators import scans as S
from barloom.plans.engine import Engine
from barloom.plans.interpreter import Interpreter
from barloom.plans.syntax import ScriptError, compile_script

PRICES = ("open", "high", "low", "close", "volume")


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(4), []
    for s in "AB":
        for i in range(60):
            c = 50 + rng.randint(-5, 5) + i * 0.5
            rows.append((s, i, c - rng.randint(0, 2), c + 2, c - 2.5, c, None if s == "B" else float(rng.randint(0, 9))))
    return spark.createDataFrame(rows, "symbol string, bar_index long, open double, high double, low double, close double, volume double").cache()


STRAIGHT = [
    "close", "hl2 + ohlc4 - volume", "x = close\ny = x[1]\ny - x", "close[2] + (close - open)[1] + ta.sma(close, 3)[1]", "x = close > open\nx[1] ? 1 : 0",
    "[m, u, l] = ta.bb(close, 5, 2)\n(close - m) / (u - l)", "f(s, n = 3) =>\n    a = ta.sma(s, n)\n    s - a\nf(close) + f(open, 4)", "ta.crossover(close, ta.sma(close, 4)) or volume == 0 and not (open < close)",
    "volume != volume[1] ? na : -close % 7", "math.max(close, volume, 5) + math.round(close / 3) + math.sign(-2) + nz(close[40], 3) + math.pow(2, 3)", "'a' + close", "close\n'text'",
    "alertcondition(close > 60, 't', 'over ' + bar_index)\nalert('always', alert.freq_all)\nlog.info('v {0} {1}', volume, close > open)\nclose", "close_of('A') + close_of('A')[1] + value_of('A', 'volume')",
    "bar_index % 4 + last_bar_index + (barstate.islast ? 100 : 0) + time - time_close", "x = 1\nx := x + close\nx += 2\nx", "float z\nz := na(z) ? close : open\nz", "ta.highest(high, 4) + ta.lowest(low, 4) + ta.change(close) + ta.rsi(close, 5)",
    "ta.stdev(close, 5, false) + ta.correlation(close, open, 6) + ta.roc(close, 2) + ta.linreg(close, 5, 1)", "n = 3\nta.sma(length = n, source = close)", "1 / volume", "ta.rising(close, 3) ? 1 : 0", "true",
]


@pytest.mark.parametrize("text", STRAIGHT)
def test_columns_equal_the_interpreter(bars, text):
    engine = Engine().register_source(bars)
    result = engine.execute(engine.compile(text))
    assert result.sinks is not None, "this program should run as columns"
    plan = result.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    data = {s: {c: [r[c] for r in bars.where(F.col("symbol") == s).orderBy("bar_index").collect()] for c in PRICES} for s in "AB"}
    got = {(r.symbol, r.bar_index): r.value for r in result.df.collect()}
    alerts = sorted((r.symbol, r.bar_index, r.time, r.message, r.freq) for r in result.alerts().collect())
    logs = sorted((r.symbol, r.bar_index, r.time, r.level, r.message) for r in result.logs().collect())
    finals = sorted((r.symbol, r.name, r.value) for r in result.variables().collect())
    want_alerts, want_logs, want_finals = [], [], []
    for s in "AB":
        columns = {c: v for c, v in data[s].items() if any(x is not None for x in v)}
        others = {("A", c): data["A"][c] for c in PRICES}
        run = Interpreter(compile_script(text), columns, symbol=s, others=others)
        for i, v in enumerate(run.run()):
            g = got[s, i]
            assert (g is None) == (v is None) and (v is None or abs(g - v) < 1e-7), (s, i, g, v)
        want_alerts += [(s, a["bar_index"], a["time"], a["message"], a["freq"]) for a in run.alerts]
        want_logs += [(s, x["bar_index"], x["time"], x["level"], x["message"]) for x in run.logs]
        want_finals += [(s, k, None if v is None else float(v)) for k, v in run.root.items() if v is None or isinstance(v, (bool, int, float))]
    assert alerts == sorted(want_alerts) and logs == sorted(want_logs)
    assert [f[:2] for f in finals] == [f[:2] for f in sorted(want_finals, key=lambda f: f[:2])]


@pytest.mark.parametrize(
    "text",
    ["ta.ema(close, 3)", "x = 0.0\nx := nz(x[1]) + close", "if close > 50\n    x = 1\nx = 2", "for i = 1 to 3\n    x = i", "close > 50 ? ta.sma(close, 3) : 0", "a = array.from(1)\narray.size(a)", "close > 50 ? (close + 1)[1] : 0", "ta.sma(close, bar_index)"],
)
def test_others_go_to_the_interpreter(bars, text):
    engine = Engine().register_source(bars)
    assert engine.execute(engine.compile(text)).sinks is None


def test_snapshot_and_replay(bars):
    engine = Engine().register_source(bars)
    program = engine.compile("if bar_index == 0\n    s = 0.0\ns += 1\nname = 'n' + bar_index\nok = close > 0\ns + 0")
    for until, n in ((None, 59), (10, 10)):
        got = {r.symbol: r for r in engine.execute(program, until=until).snapshot().collect()}
        assert {s: (r.bar_index, r.value) for s, r in got.items()} == {s: (n, n + 1.0) for s in "AB"}
        assert got["A"].variables == {"name": f"n{n}", "ok": "1", "s": str(n + 1)}
    assert engine.execute(program, symbol="B").last().collect()[0].symbol == "B"


def test_declarations_without_a_value():
    def run(text):
        engine = Interpreter(compile_script(text), {"close": [1.0, 2.0]})
        engine.run()
        return engine.last

    assert run("var float x\nna(x) ? 1 : 0") == 1 and run("bool b\nb ? 1 : 0") == 0 and run("var y\nvarip int z\nnz(y, 4) + nz(z, 2)") == 6
    with pytest.raises(ScriptError):
        compile_script("bool b = na")


def test_machines_at_their_limits():
    bars = [(3.0, 1.0, 2.0), (4.0, 2.0, 3.0), (3.0, 1.0, 1.5)]
    assert [K.Supertrend(2.0, 3)(*b) for b in bars[:1]] == [(None, None)]
    step = K.Supertrend(2.0, 3)
    assert [step(*b)[0] is None for b in bars] == [True, False, False]
    for machine, width in ((K.Supertrend(2.0, 0), 2), (K.Dmi(0, 3), 3), (K.Dmi(3, 0), 3)):
        assert all(machine(*b) == (None,) * width for b in bars)
    for sar in (K.Sar(0, 0.02, 0.2), K.Sar(0.02, 0, 0.2), K.Sar(0.02, 0.02, 0)):
        assert all(sar(*b[:2]) is None for b in bars)
    assert all(m(1.0) is None for m in (K.Ema(0), K.Ema(-1), K.Rma(0), K.Sums(0, K.Sums.mean), K.Extreme(0)))


def test_running_sums_equal_windows():
    rng = random.Random(1)
    x = [rng.choice([None, 1e6, 5.0, 5.0, 5.0, rng.gauss(0, 1)]) if i % 97 == 0 else rng.gauss(100, 3) if i < 2000 else 7.0 for i in range(3000)]
    y = [rng.gauss(0, 1) for _ in x]
    pairs = [
        (K.Sums(20, K.Sums.mean), K.Rolling(20, K.mean), 1), (K.Sums(20, K.Sums.stdev), K.Rolling(20, K.stdev), 1), (K.Sums(5, lambda s: s.var(False)), K.Rolling(5, lambda v: K.var(v, False)), 1),
        (K.Sums(20, K.Sums.correlation), K.Rolling(20, K.correlation), 2), (K.Extreme(9), K.Rolling(9, max), 1), (K.Extreme(9, -1.0), K.Rolling(9, min), 1),
    ]
    for fast, slow, count in pairs:
        for i, (a, b) in enumerate(zip(x, y, strict=True)):
            p, q = (fast(a), slow(a)) if count == 1 else (fast(a, b), slow(a, b))
            assert (p is None) == (q is None) and (p is None or abs(p - q) <= 1e-7 * max(1, abs(q))), (i, p, q)


SCANS = [
    S.sma("close", 5), S.stdev("close", 5, False), S.bb("close", 7, 2.0), S.correlation("close", "volume", 6), S.highest("high", 4), S.lowest("low", 4), S.ema("close", 5), S.rma("close", 5, "r"),
    S.atr(4), S.macd("close", 3, 6, 4), S.dmi(4, 3), S.supertrend(2.0, 4),
]


def test_whole_columns_equal_machines(spark):
    rng = random.Random(2)
    rows = [(s, i, c + 2, c - 1.5, c, float(rng.randint(1, 9))) for s in "AB" for i in range(300 if s == "A" else 3) for c in [60 + rng.gauss(0, 4)]]
    bars = spark.createDataFrame(rows, "symbol string, bar_index long, high double, low double, close double, volume double")
    names = [o for s in SCANS for o in s.outputs]
    machines = [S.Scan(s.make, s.inputs, s.outputs) for s in SCANS]
    key = lambda r: (r.symbol, r.bar_index)
    for got, want in zip(sorted(S.scan(bars, *SCANS).collect(), key=key), sorted(S.scan(bars, *machines).collect(), key=key), strict=True):
        for n in names:
            assert (got[n] is None) == (want[n] is None) and (got[n] is None or abs(got[n] - want[n]) < 1e-9 * max(1, abs(want[n]))), (n, got, want)


def test_segments_equal_whole_symbols(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 16)
    rng = random.Random(3)
    rows = [(s, i, rng.choice([None, 3.0]) if i % 31 == 30 else rng.gauss(0, 1), rng.gauss(0, 1)) for s in "AB" for i in range(100)]
    bars = spark.createDataFrame(rows, "symbol string, bar_index long, close double, volume double")
    cut = [S.sma("close", 5), S.correlation("close", "volume", 6), S.highest("close", 9), S.bb("close", 17, 2.0)]
    whole = [S.Scan(s.make, s.inputs, s.outputs) for s in cut]
    key = lambda r: (r.symbol, r.bar_index)
    got, want = (sorted(S.scan(bars, *x).collect(), key=key) for x in (cut, whole))
    assert [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want, strict=True):
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a[4:], b[4:], strict=True)), (a, b)


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    with monkeypatch.context() as m:
        m.setitem(sys.modules, "barloom.llm", None)
        m.delitem(sys.modules, "corpus_pipeline", raising=False)
        m.delitem(sys.modules, "barloom.llm.queries", raising=False)
        entry = importlib.reload(__spark_entry__)
        assert len(entry.queries()) > 90 and not any(q[2:3].isdigit() for q in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    importlib.reload(__spark_entry__)
