"""Registered queries of scripts, drawing objects, casts, matrices and the rest of the series library."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import collections as A
from barloom.functions import linalg, na
from barloom.functions import scalars as S
from barloom.operators import series as L
from barloom.plans import engine as engines
from barloom.plans.engine import Engine
from barloom.sources.bars import Catalog

from .indicators import BARS, full, lag, over
from .values import _M, QUERIES, SQL, _bars, _engine, _matrix, _r, query  # noqa: F401


def script(name: str, code: str, sql: str, *, digits: int = 6, build=_engine):
    """Registers a script's values; ``sql`` is the value's expression over bars."""

    def run(spark, sf_dir):
        e = build(spark, sf_dir)
        return e.execute(e.compile(code)).df.select("symbol", "bar_index", _r("value", digits).alias("value"))

    run.__name__ = name
    query(f"WITH {BARS} SELECT symbol, bar_index, round({sql}, {digits}) AS value FROM bars")(run)


# --- drawing ---

script(
    "script_drawing",
    """
b = box.new(bar_index, high, bar_index + 5, low)
top = box.get_top(b)
bottom = box.get_bottom(b)
box.set_right(b, bar_index + 9)
l = line.new(bar_index, low, bar_index + 1, high)
line.set_xy1(l, bar_index, open)
line.set_xy2(l, bar_index + 2, close)
line.set_color(l, color.new("red", 40))
t = label.new(bar_index, high, "x")
label.set_xy(t, bar_index + 3, low)
label.set_text(t, "now")
label.set_tooltip(t, "a tip")
g = table.new("top", 2, 2)
table.cell(g, 0, 0, "v")
f = linefill.new(l, l, "blue")
barcolor("red")
c = color.rgb(1, 2, bar_index)
d = color(3, 4, 5)
n = color.new("blue", 30)
box.delete(b)
top - bottom + b.right + l.y1 * 2 + l.y2 + l.x2 + t.x + t.y * 3 + str.length(t.text) + str.length(t.tooltip) + c.b + c.g + d.r + n.transp
""",
    "high - low + (bar_index + 9) + 2 * open + close + (bar_index + 2) + (bar_index + 3) + 3 * low + 3 + 5 + bar_index + 2 + 3 + 30",
)


@query(
    f"""WITH {BARS} SELECT symbol, bar_index, high AS top, low AS bottom, (bar_index + 9)::DOUBLE AS right_, open AS y1, close AS y2, 'red' AS line_color, (bar_index + 3)::DOUBLE AS x, 'now' AS text,
  'a tip' AS tooltip, 'table' AS table_, 'linefill' AS fill, 2.0 AS g, 40.0 AS transp FROM bars"""
)
def drawing_structs(spark, sf_dir):
    i = F.col("bar_index").cast("double")
    box = S.box_delete(S.box_new(i, F.col("high"), i + 5, F.col("low")))
    box = S.box_set_right(box, i + 9)
    line = S.set_fields(S.set_fields(S.shape("line", x1=i, y1=F.col("low"), x2=i, y2=F.col("low"), color="blue"), x1=i, y1=F.col("open")), x2=i + 2, y2=F.col("close"))
    line = S.set_fields(line, color="red")
    label = S.set_fields(S.set_fields(S.set_fields(S.shape("label", x=i, y=F.col("high"), text="x", tooltip=""), x=i + 3), text="now"), tooltip="a tip")
    return _bars(spark, sf_dir).select(
        "symbol", "bar_index", S.box_get_top(box).alias("top"), S.box_get_bottom(box).alias("bottom"), box["right"].alias("right_"), line["y1"].alias("y1"), line["y2"].alias("y2"),
        line["color"].alias("line_color"), label["x"].alias("x"), label["text"].alias("text"), label["tooltip"].alias("tooltip"), S.shape("table")["type"].alias("table_"),
        S.shape("linefill")["type"].alias("fill"), S.color_rgb(1, 2, 3)["g"].alias("g"), S.color_new("blue", 40)["transp"].alias("transp"),
    )


# --- inputs, casts, declarations, control ---

script(
    "script_inputs",
    """
len = input.int(5, "n")
f = input.float(1.5)
on = input.bool(true)
s = input.string("ab")
src = input.source(close)
tm = input.time(1000)
se = input.session("0900-1700")
sy = input.symbol("click")
co = input.color("red")
g = input(2)
x = ta.sma(src, len) * f
y = on ? x : 0.0
y + str.length(s) + str.length(se) + str.length(sy) + str.length(co) + tm + g
""",
    full(5, f"avg(close) {over(5)} * 1.5 + 2 + 9 + 5 + 3 + 1000 + 2"),
)
script(
    "script_casts",
    """
indicator("casts")
a = int(close / 7)
b = float(volume)
c = bool(volume) ? 1 : 0
d = string(bar_index)
e = fixnan(close[1])
f = math.abs(open - close) + abs(close - open)
g = timestamp(2025, 1, 2) - timestamp("UTC+2", 2025, 1, 1, 2, 0)
h = timenow > 0 ? 1 : 0
a + b + c + str.length(d) + nz(e) + f + g + h
""",
    f"trunc(close / 7) + volume + 1 + length(bar_index::VARCHAR) + coalesce({lag('close')}, 0) + 2 * abs(open - close) + 86400000 + 1",
)
script("script_declarations", "var float x\nbool b\nvarip y = 2\nx := na(x) ? close : open\nx + (b ? 1 : 0) + y", "close + 2")
script("script_qualifiers", "simple int n = 3\nseries float s = close\ninput float k = 2.0\nconst int c = 4\ns * k + n + c", "close * 2 + 7")
script(
    "script_control",
    """
type P
    float x = 1
    float y
method area(P self) => self.x * self.y
function twice(v) => v * 2
p = P.new(y = close)
p.x := 2
s = 0.0
for i = 1 to 10 by 2
    if i == 5
        continue
    if i == 9
        break
    s += i
w = 10
while w > 3
    w -= 2
w *= 3
w /= 2
w %= 2
[q, _, r] = [1, 2, 3]
k = switch
    close > open => 1
    close < open => 2
    => 3
early(v) =>
    if v > 50
        return 1
    0
z = not (close > open) and volume > 0 or false ? 1 : 0
u = -2 * -3 + 2 - -1 + 7 % 4
p.area() + twice(s) + w + q + r + k * 100 + z * 1000 + u + early(close) * 10000
""",
    "2 * close + 22 + 1 + 4 + (CASE WHEN close > open THEN 1 WHEN close < open THEN 2 ELSE 3 END) * 100 + (CASE WHEN close <= open AND volume > 0 THEN 1000 ELSE 0 END) + 12"
    " + (CASE WHEN close > 50 THEN 10000 ELSE 0 END)",
)
script(
    "script_arrays",
    """
a = array.new_float(3, 1.5)
array.unshift(a, close)
b = array.copy(a)
array.push(b, open)
c = array.from(1, 2, 3)
d = array.new_int(2, 7)
e = array.new_bool(1, true)
f = array.new_string(2, "x")
g = array.new_box(1)
array.size(a) + array.size(b) * 10 + array.get(b, 0) + array.get(b, 4) + array.binary_search_leftmost(c, 2) + array.binary_search_rightmost(c, 3) + array.sum(d) + array.size(e) + array.size(f) + array.size(g) + [4, 5, 6][1]
""",
    "4 + 50 + close + open + 1 + 2 + 14 + 1 + 2 + 1 + 5",
)
script(
    "script_maps",
    "m = map.new<string,float>()\nmap.put(m, 'a', close)\nn = map.copy(m)\nmap.put(n, 'b', open)\nmap.size(m) + map.size(n) * 10 + map.get(n, 'b') + map.get(m, 'a')",
    "1 + 20 + open + close",
)


@query(
    f"""WITH {BARS}, a AS (SELECT *, max(high) {over(5)} AS hi, {full(10, f'avg(close) {over(10)}')} AS m, {full(10, f'stddev_pop(close) {over(10)}')} AS s FROM bars),
b AS (SELECT *, (close - m) / nullif(4 * s, 0) AS d FROM a),
c AS (SELECT *, {lag('d')} AS d1, {lag('m')} AS m1, {lag('close')} AS c1 FROM b)
SELECT symbol, bar_index, round((CASE WHEN coalesce(d1 > d, false) AND close <> open THEN CASE WHEN bar_index >= 4 THEN hi - close END ELSE coalesce(d, 0) END)
  + (CASE WHEN coalesce(c1 <= m1 AND close > m, false) THEN 1 ELSE 0 END) + bar_index % 3, 6) AS value FROM c"""
)
def script_columns(spark, sf_dir):
    """A straight-line program: it runs as columns."""
    code = "hi = ta.highest(high, 5)\n[m, u, l] = ta.bb(close, 10, 2)\nd = (close - m) / (u - l)\ndown = d[1] > d and close != open\nx = down ? hi - close : nz(d)\nx + (ta.crossover(close, m) ? 1 : 0) + bar_index % 3"
    e = _engine(spark, sf_dir)
    return e.execute(e.compile(code)).df.select("symbol", "bar_index", _r("value").alias("value"))


def _event_engine(spark, sf_dir):
    return Engine(default_value_type="event").register_source(_bars(spark, sf_dir).select("symbol", "bar_index", F.col("close").alias("event")))


script("script_value_fallback", "close + nz(close[1]) + hl2", f"2 * close + coalesce({lag('close')}, 0)", build=_event_engine)


def _hooked(spark, sf_dir):
    return _engine(spark, sf_dir).register_function("request.security", lambda name: 42.0)


script("script_hooks", "close + request.security('x')", "close + 42", build=_hooked)


@query(f"WITH {BARS} SELECT symbol, bar_index, 'top' AS message, 'all' AS freq, (1735689600000 + (bar_index + 1) * 3600000)::DOUBLE AS time FROM bars WHERE close > 95")
def script_alert_calls(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return e.execute(e.compile("if close > 95\n    alert('top', alert.freq_all)")).alerts().select("symbol", "bar_index", "message", "freq", "time")


@query(
    f"""WITH {BARS} SELECT symbol, bar_index, 'warning' AS level, 'w ' || bar_index AS message FROM bars WHERE bar_index % 50 = 0
UNION ALL SELECT symbol, bar_index, 'error', 'e' FROM bars WHERE bar_index % 50 = 0"""
)
def script_log_levels(spark, sf_dir):
    e = _engine(spark, sf_dir)
    code = "if bar_index % 50 == 0\n    log.warning('w {0}', bar_index)\n    log.error('e')"
    return e.execute(e.compile(code)).logs().select("symbol", "bar_index", "level", "message")


@query(f"WITH {BARS} SELECT symbol, bar_index, round((high + low) / 2, 6) AS value FROM bars WHERE symbol = 'click'")
def execute_symbol(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return e.execute(e.compile("hl2"), symbol="click").df.select("symbol", "bar_index", _r("value").alias("value"))


@query(f"WITH {BARS} SELECT symbol, round(sum(close), 4) AS value, 20 AS bar_index FROM bars WHERE bar_index <= 20 GROUP BY symbol HAVING max(bar_index) = 20")
def replay_until(spark, sf_dir):
    """The state at bar 20, as a run that stops there sees it."""
    e = _engine(spark, sf_dir)
    run = e.execute(e.compile("if bar_index == 0\n    s = 0.0\ns += close\nname = 'n'\ns + 0"), until=20)
    return run.snapshot().where("variables['name'] = 'n'").select("symbol", _r("value", 4).alias("value"), F.col("bar_index").cast("int").alias("bar_index"))


@query(f"WITH {BARS} SELECT symbol, bar_index, round((open + high + low + close) / 4, 6) AS value FROM bars")
def default_engine(spark, sf_dir):
    """A program stored by one engine runs in the package's default engine."""
    program = Engine().compile("ohlc4")
    engines.default.catalog = Catalog()
    engines.register_source(_bars(spark, sf_dir))
    return engines.execute(program).df.select("symbol", "bar_index", _r("value").alias("value"))


@query("SELECT unnest(['close', 'high', 'low', 'open', 'volume']) AS name")
def value_types(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in _engine(spark, sf_dir).value_types()], "name string")


# --- the rest of the matrix functions ---


@query(
    _M.replace("a[4] AS s", "a[4] AS s, a[5] AS t, a[6] AS u")
    + """ SELECT symbol, bar_index, [3::DOUBLE, 3, 3, 3] AS new, [p, q, r, s] AS cp, [0.5, q, 0.5, s] AS fi, [p, 2 * p, q, 2 * q, r, 2 * r, s, 2 * s] AS kr, [0.0, round(q - r, 6), round(r - q, 6), 0.0] AS di,
  least(p, q, r, s) AS mn, round((list_sort([p, q, r, s])[2] + list_sort([p, q, r, s])[3]) / 2, 6) AS md, least(p, q) AS mo, p > 50 AS bi, p > 50 AS ad, p > 50 AS an, p <= 50 AS st FROM q"""
)
def matrix_more(spark, sf_dir):
    p, q, r, s = (F.get("a", F.lit(i)) for i in range(4))
    m, flag, lit = F.col("m"), F.col("p") > 50, F.lit
    one, none = lit(1.0), lit(0.0)
    kron = A.m_kron(m, A.m_from([1.0, 2.0]))
    diff = F.transform(F.flatten(A.m_diff(m, A.m_transpose(m))), lambda x: F.round(x, 6) + 0.0)
    return _matrix(spark, sf_dir).withColumns({"p": p, "q": q}).select(
        "symbol", "bar_index", F.flatten(A.m_new(2, 2, 3.0)).alias("new"), F.flatten(A.m_copy(m)).alias("cp"), F.flatten(A.m_fill(m, 0.5, 0, 2, 0, 1)).alias("fi"), F.flatten(kron).alias("kr"),
        diff.alias("di"), A.m_stat(m, A.min_).alias("mn"), _r(A.m_stat(m, A.median)).alias("md"), A.m_stat(A.m_from([p, q], [q, p]), A.mode).alias("mo"),
        A.m_is(A.m_from([F.when(flag, one).otherwise(2.0), none], [one, none]), "binary").alias("bi"),
        A.m_is(A.m_from([F.when(flag, none).otherwise(1.0), q], [r, none]), "antidiagonal").alias("ad"),
        A.m_is(A.m_from([none, q], [-q + F.when(flag, none).otherwise(1.0), none]), "antisymmetric").alias("an"),
        A.m_is(A.m_from([lit(0.25), lit(0.75)], [p / 50, 1 - p / 50]), "stochastic").alias("st"),
    )


@query(
    _M
    + """, y AS (SELECT symbol, bar_index, p + 500 AS a, (q + r) / 2 AS h, p + 300 AS d, q, r, p + 10 AS x1, q + 20 AS x2, r + 30 AS x3 FROM q),
z AS (SELECT *, a * d - h * h AS det, (a + d) / 2 + sqrt(10000 + h * h) AS l1, x1 * x1 + x2 * x2 + x3 * x3 AS sx, x1 + 2 * x2 + 5 * x3 AS sy, x1 * x1 + x2 * x2 + x3 * x3 AS xx FROM y)
SELECT symbol, bar_index, [round(d / det, 9), round(-h / det, 9), round(a / det, 9)] AS inv, [round(a * a + h * h, 7), round(a * h + h * d, 7), round(h * h + d * d, 7)] AS po,
  [round(abs(l1 - d) / sqrt((l1 - d) ** 2 + h * h), 4), round(abs(h) / sqrt((l1 - d) ** 2 + h * h), 4)] AS ev, round((a + d) / 2 + sqrt(10000 + q * r), 3) AS e1, round((a + d) / 2 - sqrt(10000 + q * r), 3) AS e2,
  [round((30 * x1 - sy) / (30 * xx - sy * sy), 9), round((xx - sy * x1) / (30 * xx - sy * sy), 9)] AS pi FROM z"""
)
def matrix_inverses(spark, sf_dir):
    p, q, r = (F.get("a", F.lit(i)) for i in range(3))
    half = (q + r) / 2
    df = _matrix(spark, sf_dir).select(
        "symbol", "bar_index", A.m_from([p + 500, half], [half, p + 300]).alias("y"), A.m_from([p + 500, q], [r, p + 300]).alias("z"), A.m_from([p + 10, 1.0], [q + 20, 2.0], [r + 30, 5.0]).alias("t")
    )
    y = F.col("y")
    df = df.select(
        "symbol", "bar_index", linalg.inv_col(y).alias("i"), linalg.power_col(y, 2).alias("w"), linalg.eigenvectors_col(y).alias("v"), linalg.eigenvalues_col(F.col("z")).alias("e"), linalg.pinv_col(F.col("t")).alias("g")
    )
    at = lambda c, i, j: F.get(F.get(c, F.lit(i)), F.lit(j))
    return df.select(
        "symbol", "bar_index", F.array(*(_r(at("i", *ij), 9) for ij in ((0, 0), (0, 1), (1, 1)))).alias("inv"), F.array(*(_r(at("w", *ij), 7) for ij in ((0, 0), (0, 1), (1, 1)))).alias("po"),
        F.array(_r(F.abs(at("v", 0, 0)), 4), _r(F.abs(at("v", 1, 0)), 4)).alias("ev"), _r(F.get("e", F.lit(0)), 3).alias("e1"), _r(F.get("e", F.lit(1)), 3).alias("e2"),
        F.array(_r(at("g", 0, 0), 9), _r(at("g", 1, 0), 9)).alias("pi"),
    )


# --- the rest of the series library ---


@query(
    f"""WITH {BARS}, w AS (SELECT *, {lag('close')} AS c1, {lag('open')} AS o1, list(close) {over(3)} AS l3, regr_slope(close, bar_index) {over(6)} AS m, regr_intercept(close, bar_index) {over(6)} AS k FROM bars)
SELECT symbol, bar_index, max(close) {over(6)} AS mx, min(close) {over(6)} AS mn, abs(close - open) AS ab, {full(6, 'round(k + m * bar_index, 5)')} AS al, {full(6, 'round(-m, 5)')} AS be,
  {full(6, f'round(regr_intercept(volume, close) {over(6)}, 4)')} AS oa, {full(6, f'round(regr_slope(volume, close) {over(6)}, 6)')} AS ob, l3 AS re,
  CASE WHEN bar_index >= 6 THEN round(corr(close, c1) {over(6)}, 6) END AS ac, {full(6, f'round(corr(close, volume) {over(6)}, 6)')} AS co, round(sum(-volume * ln(volume + 1)) {over(6)}, 4) AS ce,
  round(close + open, 6) AS ad, round(close - open, 6) AS su, round(close * open, 6) AS mu, round(close / nullif(open, 0), 6) AS dv, coalesce(c1 > o1 AND close < open, false) AS xu,
  CASE WHEN min(close - 50) {over(4)} >= 0 THEN round(sum(CASE WHEN close > 50 THEN -(close - 50) * ln(close - 50) ELSE 0 END) {over(4)}, 4) END AS en FROM w"""
)
def series_more(spark, sf_dir):
    c, o, v = F.col("close"), F.col("open"), F.col("volume")
    ok = F.col("bar_index") >= 5
    alpha, beta = L.linear_regression(c, 6)
    oa, ob = L.ols(c, v, 6)
    return _bars(spark, sf_dir).select(
        "symbol", "bar_index", L.maximum(c, 6).alias("mx"), L.minimum(c, 6).alias("mn"), L.abs_(c - o).alias("ab"), F.when(ok, _r(alpha, 5)).alias("al"), F.when(ok, _r(beta, 5)).alias("be"),
        F.when(ok, _r(oa, 4)).alias("oa"), F.when(ok, _r(ob, 6)).alias("ob"), L.reverse(c, 3).alias("re"), F.when(F.col("bar_index") >= 6, _r(L.auto_correlation(c, 6, 1))).alias("ac"),
        F.when(ok, _r(L.correlation(c, v, 6, "pearson"))).alias("co"), _r(L.cross_entropy(v, v + 1, 6), 4).alias("ce"), _r(L.add(c, o)).alias("ad"), _r(L.sub(c, o)).alias("su"),
        _r(L.mul(c, o)).alias("mu"), _r(L.div_(c, o)).alias("dv"), L.cross_under(c, o).alias("xu"), _r(L.entropy(c - 50, 4), 4).alias("en"),
    )


@query(
    f"""WITH {BARS}, w AS (SELECT *, regr_slope(close, bar_index) {over(6)} AS m, regr_intercept(close, bar_index) {over(6)} AS k, regr_slope(open, bar_index) {over(6)} AS n, regr_intercept(open, bar_index) {over(6)} AS j FROM bars),
t AS (SELECT *, (j + n * bar_index - k - m * bar_index) / nullif(m - n, 0) AS t FROM w WHERE bar_index >= 5)
SELECT symbol, bar_index, t > 0 AS found, CASE WHEN t > 0 THEN ceil(t) ELSE 0 END::DOUBLE AS ahead, CASE WHEN t > 0 THEN round(k + m * bar_index + m * t, 3) ELSE 0 END AS value FROM t WHERE abs(t - round(t)) > 1e-6"""
)
def series_next_cross(spark, sf_dir):
    c, o = F.col("close"), F.col("open")
    x = L.next_cross(c, o, 6)
    a, b = L.linear_regression(c, 6), L.linear_regression(o, 6)
    t = na.div(b[0] - a[0], b[1] - a[1])
    df = _bars(spark, sf_dir).select("symbol", "bar_index", x.alias("x"), t.alias("t")).where((F.col("bar_index") >= 5) & (F.abs(F.col("t") - F.round("t")) > 1e-6))
    return df.select("symbol", "bar_index", F.col("x.found").alias("found"), F.col("x.bars").alias("ahead"), _r("x.value", 3).alias("value"))


# --- rolling machines over whole columns ---


@query(
    f"""WITH {BARS} SELECT symbol, bar_index, {full(20, f'round(avg(close) {over(20)}, 6)')} AS sma, {full(20, f'round(avg(close) {over(20)} + 2 * stddev_pop(close) {over(20)}, 6)')} AS bb_up,
  {full(20, f'round(stddev_pop(close) {over(20)}, 6)')} AS stdev, {full(20, f'round(corr(close, volume) {over(20)}, 6)')} AS correlation, {full(20, f'max(close) {over(20)}')} AS highest,
  {full(20, f'min(close) {over(20)}')} AS lowest FROM bars"""
)
def rolling_scan(spark, sf_dir):
    from barloom.operators import scans

    out = scans.scan(
        _bars(spark, sf_dir), scans.sma("close", 20), scans.bb("close", 20, 2.0), scans.stdev("close", 20), scans.correlation("close", "volume", 20), scans.highest("close", 20), scans.lowest("close", 20)
    )
    return out.select("symbol", "bar_index", *(_r(c).alias(c) for c in ("sma", "bb_up", "stdev", "correlation")), "highest", "lowest")
