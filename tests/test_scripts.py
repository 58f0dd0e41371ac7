"""Scripts over literal series, run by the interpreter without Spark."""

import math
from datetime import datetime

import pytest

from barloom.plans.interpreter import Interpreter
from barloom.plans.syntax import ScriptError, compile_script


def run(text, others=None, functions=None, symbol="S", **columns):
    engine = Interpreter(compile_script(text), {k: [float(x) for x in v] for k, v in columns.items()}, others=others, functions=functions, symbol=symbol)
    engine.run()
    return engine.last


@pytest.mark.parametrize(
    ("text", "columns", "expected"),
    [
        ("ta.atr(3)", {"high": [10, 13, 12, 20], "low": [8, 9, 11, 14], "close": [9, 10, 11, 15]}, 4.7777777778),
        ("ta.stdev(close,4)+ta.stdev(close,4,false)+ta.correlation(close,close*2,4)+ta.correlation(close,0-close,4)", {"close": [1, 2, 3, 4]}, 2.4090284375),
        ("ta.change(close,2)+ta.highest(close,3)+ta.lowest(close,3)", {"close": [10, 12, 11, 15]}, 3 + 15 + 11),
        ("ta.vwma(close,3)", {"close": [1, 2, 3, 4], "volume": [10, 10, 20, 20]}, 3.2),
        ("ta.percentile_linear_interpolation(close,5,50)+ta.percentile_nearest_rank(close,5,50)+ta.percentrank(close,5)", {"close": range(1, 11)}, 116),
        ("[p,r1,s1] = ta.pivot_point_levels('Traditional', true)\nx = ta.pivot_point_levels('Traditional', true)\narray.get(x,0)*100+array.get(x,1)*10+array.get(x,4)", {"high": [10, 12], "low": [8, 9], "close": [9, 11]}, 900 + 100 + 8),
        ("close[1]", {"close": [10, 20, 30]}, 20),
        ("x = close\nx[1]", {"close": [10, 20, 30]}, 20),
        ("(close+1)[1]", {"close": [10, 20, 30]}, 21),
        ("ta.sma(close,2)[1]", {"close": [1, 2, 3]}, 1.5),
        ("nz(close[10],7)+(na(na) ? 1 : 0)+bar_index", {"close": [10, 20, 30]}, 10),
        ("var x = 1\nx = x + 2*3\nx", {"close": [1, 2, 3]}, 7),
        ("if bar_index == 0\n    x = 0\nx = x + 1\nx", {"close": [1, 2, 3]}, 3),
        ("ta.crossover(close,1.5)[1]", {"close": [1, 2, 3]}, 1),
        ("ta.crossunder(close,2.5)[1]", {"close": [3, 2, 1]}, 1),
        ("x = 0.0\nfor i = 1 to 4\n    if i == 3\n        continue\n    x += i\nx", {"close": [1]}, 7),
        ("x = 10\nwhile x > 3\n    x -= 2\nx", {"close": [1]}, 2),
        ("f(a, b = 2) => a * b\nf(3) + f(3, 4)", {"close": [1]}, 18),
        ("f(x) =>\n    y = x * 2\n    if y > 5\n        y := 5\n    y\nf(close)", {"close": [4]}, 5),
        ("type P\n    float x = 1\n    float y\np = P.new(y = 4)\np.x := 3\np.x + p.y", {"close": [1]}, 7),
        ("x = switch close\n    1 => 10\n    2 => 20\n    => 30\nx", {"close": [1, 2]}, 20),
        ("x = 0\nswitch\n    close > 5 => x := 1\n    close > 1 => x := 2\n    => x := 3\nx", {"close": [2]}, 2),
        ("[a, _, c] = [1, 2, 3]\na + c", {"close": [1]}, 4),
        ("m = matrix.new<float>(2,2,0)\nmatrix.set(m,0,0,2)\nmatrix.set(m,1,1,3)\nv = matrix.eigenvalues(m)\narray.get(v,0) + matrix.det(m) + matrix.rank(m)", {"close": [1]}, 3 + 6 + 2),
        ("a = array.from(1,-2,3)\narray.push(a, 5)\na.size() + a.sum() + array.max(a, 1) + array.indexof(a, 3)", {"close": [1]}, 4 + 7 + 3 + 2),
        ("m = map.new<string,float>()\nmap.put(m, 'a', 2)\nm.put('b', 3)\nm.size() + map.get(m, 'b') + (map.contains(m, 'z') ? 1 : 0)", {"close": [1]}, 5),
        ("str.length(str.format('{0,number,#.##} {1} {{x}}', 1.005, 'ab'))", {"close": [1]}, len("1 ab {x}")),
        ("hl2 + hlc3 + ohlc4", {"open": [1], "high": [4], "low": [2], "close": [3]}, 3 + 3 + 2.5),
        ("5 % 3 + -5 % 3 + nz(1 / 0, 9)", {"close": [1]}, 2 - 2 + 9),
        ("-2 * -3 + (1 < 2 and not false ? 1 : 0)", {"close": [1]}, 7),
        ("timeframe.change('120') ? 1 : 0", {"close": [1, 2, 3, 4]}, 1),
        ("timeframe.in_seconds('1D') + timeframe.in_seconds()", {"close": [1]}, 86400 + 3600),
        ("timestamp('UTC+2', 2025, 1, 1, 2, 0) - timestamp(2025, 1, 1)", {"close": [1]}, 0),
        ("math.max(1, na) ? 1 : 2", {"close": [1]}, 2),
        ("math.round(2.5) + math.round(-2.5) + math.sign(-3) + math.pow(2, 3)", {"close": [1]}, 3 - 3 - 1 + 8),
        ("s = close\nt = ta.sma(s, 3)\nta.highest(t, 2)", {"close": [1, 2, 3, 4]}, 3),
        ("ta.valuewhen(close > 2, close, 1)", {"close": [1, 3, 4, 2]}, 3),
        ("ta.barssince(close > 3)", {"close": [1, 4, 2, 2]}, 2),
        ("ta.macd(close,3,6,2)\n[m,s,h] = ta.macd(close,3,6,2)\nm*100+s*10+h", {"close": range(1, 11)}, 138.09524794 + 13.537043198 + 0.0272481597),
        ("ta.hma(close,5)", {"close": range(1, 11)}, 10.3333333333),
    ],
)
def test_value(text, columns, expected):
    assert run(text, **columns) == pytest.approx(expected, abs=1e-6)


HLCV = {"high": range(2, 14), "low": range(0, 12), "close": range(1, 13), "volume": range(100, 321, 20)}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("ta.tsi(close,3,5)", 100.0),
        ("[a,b,c] = ta.dmi(5,5)\na", 45.705032704),
        ("[a,b,c] = ta.dmi(5,5)\nb + c", 100.0),
        ("[a,b] = ta.supertrend(3,5)\na * 10 + b", 61.0),
        ("[a,b,c] = ta.kc(close,5,1.5)\na", 10.0231220399),
        ("[a,b,c] = ta.kc(close,5,1.5)\nb - c", 6.0),
        ("ta.sar(0.02,0.02,0.2)", 7.26647496389),
    ],
)
def test_recursive_indicators(text, expected):
    assert run(text, **HLCV) == pytest.approx(expected, abs=1e-6)


def test_utility_indicators():
    columns = {"high": [1, 2, 5, 2, 1], "low": [3, 2, 0, 2, 3], "close": [1, 2, 3, 4, 5], "volume": [10] * 5}
    for text, expected in [
        ("ta.cum(close)", 15), ("ta.highestbars(high,5)", 2), ("ta.lowestbars(low,5)", 2), ("ta.max(close)", 5), ("ta.min(close)", 1),
        ("ta.median(close,5)", 3), ("ta.mode(close,5)", 1), ("ta.range(close,5)", 4), ("ta.variance(close,5)", 2), ("ta.dev(close,5)", 1.2),
        ("ta.rising(close,3)", 1), ("ta.falling(close,3)", 0), ("ta.pivothigh(2,2)", 5), ("ta.pivotlow(2,2)", 0), ("ta.tr()", 3),
        ("ta.cross(close,ta.sma(close,2))", 0), ("ta.valuewhen(close>2,close,0)", 5),
    ]:
        assert run(text, **columns) == pytest.approx(expected), text


def test_bands_equal_their_formula():
    text = "[m,u,l] = ta.bb(close,5,2)\ns = ta.sma(close,5)\nd = ta.stdev(close,5)\nmath.abs(m-s)+math.abs(u-s-2*d)+math.abs(ta.bbw(close,5,2)-(u-l)/m)"
    assert run(text, close=range(1, 11)) == pytest.approx(0, abs=1e-10)


def test_matrix_predicates():
    assert run("m = matrix.new<float>(2,2,0)\n(matrix.is_zero(m) ? 1 : 0) + (matrix.is_square(m) ? 1 : 0) + (matrix.is_identity(m) ? 1 : 0) + (m.is_stochastic() ? 1 : 0)", close=[1]) == 2


def test_cross_symbol_and_fallback():
    others = {("B", "close"): [10.0, 20.0, 30.0]}
    assert run("close_of('B')[1] + close_of('S')", others=others, close=[1, 2, 3]) == 23
    assert run("sma_of('B', 2) + value_of('B', 'missing')", others=others, close=[1, 2, 3]) == 55
    assert run("close + close[1]", event=[1, 2, 3], symbol="E") == 5


def test_hooks_and_named_arguments():
    assert run("twice(4)", functions={"twice": (lambda x: 2 * x, None)}, close=[1]) == 8
    assert run("f(b = 2, a = 5)", functions={"f": (lambda a, b: a - b, ["a", "b"])}, close=[1]) == 3
    assert run("request.security('x')", functions={"request.security": (lambda s: 42.0, None)}, close=[1]) == 42
    assert run("ta.sma(length = 2, source = close)", close=[1, 3]) == 2


def test_alerts_and_logs():
    engine = Interpreter(compile_script("alertcondition(close > 1, 't', 'up')\nlog.info('v {0,number,#.########}', close / 3)"), {"close": [1.0, 10.0]}, start=datetime(2025, 1, 1))
    engine.run()
    assert [a["bar_index"] for a in engine.alerts] == [1]
    assert [x["message"] for x in engine.logs] == ["v 0.33333333", "v 3.33333333"]


@pytest.mark.parametrize(
    "text",
    ["if close\n    x = 1", "x = not 1", "bool b = 1", "bool b = na", "x = true and 2", "enum A", "import x", "x = close ? 1 : 2", "x = 2 ^ 3", "x = (1", "f(a = 1, 2)"],
)
def test_compile_errors(text):
    with pytest.raises(ScriptError):
        compile_script(text)


@pytest.mark.parametrize(
    "text",
    ["strategy.entry('x')", "plot(close)", "nz(true)", "na(close > 1)", "x = array.from(1)\nx.get(5)", "unknown(1)", "close[-1]", "const c = 1\nc := 2", "array.pop(array.new_float(0))", "x.nope()", "ta.sma(length = 2)"],
)
def test_runtime_errors(text):
    with pytest.raises(ScriptError):
        run(text, close=[1, 2])


def test_number_text():
    from barloom.plans.builtins import text

    for v, expected in [(3.0, "3"), (1e6, "1e+06"), (123456.0, "123456"), (1234567.0, "1.234567e+06"), (1e21, "1e+21"), (1e-5, "1e-05"), (0.1, "0.1"), (-2.5, "-2.5"), (None, "na"), (math.inf, "+Inf")]:
        assert text(v) == expected
