"""Registered indicator queries over hourly bars of ``events``, with SQL written from the formulas."""

# ruff: noqa: E741, N803

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import cross as X
from barloom.operators import scans as S
from barloom.operators import windows as T
from barloom.sources.bars import derived, hourly_events

BARS = """
raw AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_time, arg_min(value, ts) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY ALL),
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_time) - 1 AS bar_index FROM raw)"""
P = "PARTITION BY symbol ORDER BY bar_index"


def over(n: int | None = None, last: int = 0) -> str:
    """A frame of n rows that ends ``last`` rows before the current one; None: all so far."""
    first = "UNBOUNDED PRECEDING" if n is None else f"{n - 1} PRECEDING"
    return f"OVER ({P} ROWS BETWEEN {first} AND {f'{last} PRECEDING' if last else 'CURRENT ROW'})"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def full(n: int, value: str, x: str = "close") -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {value} END"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _rounded(df: DataFrame, names: list[str], digits: int) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.round(n, digits).alias(n) if kinds[n] == "double" else F.col(n) for n in names]


def window(name: str, columns: Callable[..., dict[str, Column]], sql: dict[str, str], *, ctes: str = "", source: str = "bars", digits: int = 6) -> None:
    """Registers a query of window columns, made from the five prices, and its SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = derived(hourly_events(spark, sf_dir))
        made = columns(*(F.col(c) for c in ("close", "open", "high", "low", "volume")))
        out = bars.select("symbol", "bar_index", *(c.alias(n) for n, c in made.items()))
        return out.select("symbol", "bar_index", *_rounded(out, list(made), digits))

    _register(name, query, sql, ctes, source, digits)


def scanned(name: str, scans: list[S.Scan], sql: dict[str, str], *, ctes: str, source: str, digits: int = 6) -> None:
    """Registers a query of one packed scan pass and its SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = S.scan(hourly_events(spark, sf_dir), *scans)
        return out.select("symbol", "bar_index", *_rounded(out, list(sql), digits))

    _register(name, query, sql, ctes, source, digits)


def joined(name: str, build: Callable[[DataFrame], DataFrame], sql: dict[str, str], *, ctes: str = "", source: str = "bars", digits: int = 6) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(hourly_events(spark, sf_dir))
        return out.select("symbol", "bar_index", *_rounded(out, list(sql), digits))

    _register(name, query, sql, ctes, source, digits)


def _register(name, query, sql, ctes, source, digits) -> None:
    QUERIES[name] = query
    picked = ", ".join(
        (f"{e} AS {n}" if n.startswith(("is_", "n_", "t_", "s_")) else f"round({e}, {digits}) AS {n}") for n, e in sql.items()
    )
    SQL[name] = f"WITH RECURSIVE {BARS}{',' + ctes if ctes else ''}\nSELECT symbol, bar_index, {picked} FROM {source}"


def _weights(x: str, weights: list[float]) -> str:
    n = len(weights)
    return " + ".join(f"{w!r} * {x if i == n - 1 else lag(x, n - 1 - i)}" for i, w in enumerate(weights))


# --- sources ---


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derived(hourly_events(spark, sf_dir))
    names = ["open", "high", "low", "close", "volume", "hl2", "hlc3", "hlcc4", "ohlc4"]
    return out.select("symbol", "bar_index", "bar_time", *_rounded(out, names, 6))


QUERIES["bars_hourly"] = bars_hourly
SQL["bars_hourly"] = f"""WITH {BARS}
SELECT symbol, bar_index, bar_time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
  round(close, 6) AS close, volume, round((high + low) / 2, 6) AS hl2, round((high + low + close) / 3, 6) AS hlc3,
  round((high + low + 2 * close) / 4, 6) AS hlcc4, round((open + high + low + close) / 4, 6) AS ohlc4 FROM bars"""

# --- moving averages ---

window("sma", lambda C, O, H, L, V: {"v": T.sma(C, 20)}, {"v": full(20, f"avg(close) {over(20)}")})
window("wma", lambda C, O, H, L, V: {"v": T.wma(C, 10)}, {"v": f"list_sum(list_transform(list_zip(list(close) {over(10)}, range(1, 11)), lambda z: z[1] * z[2])) / 55 * {full(10, '1')}"})
window("swma", lambda C, O, H, L, V: {"v": T.swma(C)}, {"v": f"(close + 2 * {lag('close')} + 2 * {lag('close', 2)} + {lag('close', 3)}) / 6"})
_HMA = f"""
h1 AS (SELECT *, 2 * ({_weights('close', [(i + 1) / 10 for i in range(4)])}) - ({_weights('close', [(i + 1) / 45 for i in range(9)])}) AS x FROM bars)"""
window("hma", lambda C, O, H, L, V: {"v": T.hma(C, 9)}, {"v": _weights("x", [(i + 1) / 6 for i in range(3)])}, ctes=_HMA, source="h1")
window(
    "alma",
    lambda C, O, H, L, V: {"v": T.alma(C, 9, 0.85, 6.0)},
    {
        "v": full(
            9,
            f"list_sum(list_transform(list_zip(list(close) {over(9)}, range(0, 9)), lambda z: z[1] * exp(-((z[2] - 6.8) ** 2) / (2 * 1.5 * 1.5))))"
            " / list_sum(list_transform(range(0, 9), lambda i: exp(-((i - 6.8) ** 2) / (2 * 1.5 * 1.5))))",
        )
    },
)
window(
    "linreg",
    lambda C, O, H, L, V: {"v": T.linreg(C, 14, 2)},
    {"v": full(14, f"regr_intercept(close, bar_index) {over(14)} + regr_slope(close, bar_index) {over(14)} * (bar_index - 2)")},
    digits=5,
)
window("vwma", lambda C, O, H, L, V: {"v": T.vwma(C, V, 10)}, {"v": full(10, f"sum(close * volume) {over(10)} / sum(volume) {over(10)}")}, digits=9)

# --- oscillators ---

_UD = f"""
d0 AS (SELECT *, close - {lag('close')} AS d FROM bars),
ud AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM d0),
m AS (SELECT *, count(d) {over(14)} AS n, sum(up) {over(14)} AS u, sum(down) {over(14)} AS w FROM ud)"""
window(
    "rsi",
    lambda C, O, H, L, V: {"v": T.rsi(C, 14)},
    {"v": "CASE WHEN n = 14 THEN CASE WHEN u = 0 AND w = 0 THEN 50 WHEN w = 0 THEN 100 ELSE 100 * u / (u + w) END END"},
    ctes=_UD, source="m",
)
window("cmo", lambda C, O, H, L, V: {"v": T.cmo(C, 14)}, {"v": "CASE WHEN n = 14 THEN CASE WHEN u + w = 0 THEN 0 ELSE 100 * (u - w) / (u + w) END END"}, ctes=_UD, source="m")
_AVG = f"\nm AS (SELECT *, avg(close) {over(20)} AS avg_, count(close) {over(20)} AS n, list(close) {over(20)} AS l FROM bars)"
_MAD = "list_avg(list_transform(l, lambda x: abs(x - avg_)))"
window("dev", lambda C, O, H, L, V: {"v": T.dev(C, 20)}, {"v": f"CASE WHEN n = 20 THEN {_MAD} END"}, ctes=_AVG, source="m")
window("cci", lambda C, O, H, L, V: {"v": T.cci(C, 20)}, {"v": f"CASE WHEN n = 20 THEN (close - avg_) / (0.015 * {_MAD}) END"}, ctes=_AVG, source="m")
window(
    "cog",
    lambda C, O, H, L, V: {"v": T.cog(C, 10)},
    {"v": full(10, f"-list_sum(list_transform(list_zip(list(close) {over(10)}, range(1, 11)), lambda z: z[1] * z[2])) / sum(close) {over(10)}")},
)
window("mom", lambda C, O, H, L, V: {"v": T.mom(C, 10)}, {"v": f"close - {lag('close', 10)}"})
window("roc", lambda C, O, H, L, V: {"v": T.roc(C, 9)}, {"v": f"100 * (close - {lag('close', 9)}) / nullif({lag('close', 9)}, 0)"})
window("change", lambda C, O, H, L, V: {"v": T.change(C)}, {"v": f"close - {lag('close')}"})
window("stoch", lambda C, O, H, L, V: {"v": T.stoch(C, H, L, 14)}, {"v": full(14, f"100 * (close - min(low) {over(14)}) / nullif(max(high) {over(14)} - min(low) {over(14)}, 0)")})
window(
    "mfi",
    lambda C, O, H, L, V: {"v": T.mfi((H + L + C) / 3, V, 14)},
    {"v": "CASE WHEN n = 14 THEN CASE WHEN neg = 0 THEN 100 WHEN pos = 0 THEN 0 ELSE 100 * pos / (pos + neg) END END"},
    ctes=f"""
t AS (SELECT *, (high + low + close) / 3 AS x FROM bars), t1 AS (SELECT *, x - {lag('x')} AS d FROM t),
t2 AS (SELECT *, count(d) {over(14)} AS n, sum(CASE WHEN d > 0 THEN x * volume ELSE 0 END) {over(14)} AS pos,
              sum(CASE WHEN d < 0 THEN x * volume ELSE 0 END) {over(14)} AS neg FROM t1)""",
    source="t2",
)
window("wpr", lambda C, O, H, L, V: {"v": T.wpr(H, L, C, 14)}, {"v": full(14, f"0 - 100 * (max(high) {over(14)} - close) / nullif(max(high) {over(14)} - min(low) {over(14)}, 0)")})

# --- bands and volatility ---

_TR = f"\ntr AS (SELECT *, CASE WHEN bar_index = 0 THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr FROM bars)"
window("tr", lambda C, O, H, L, V: {"v": T.tr(H, L, C)}, {"v": "tr"}, ctes=_TR, source="tr")
window(
    "bb",
    lambda C, O, H, L, V: dict(zip(("mid", "up", "low"), T.bb(C, 20, 2.0), strict=True)),
    {
        "mid": full(20, f"avg(close) {over(20)}"),
        "up": full(20, f"avg(close) {over(20)} + 2 * stddev_pop(close) {over(20)}"),
        "low": full(20, f"avg(close) {over(20)} - 2 * stddev_pop(close) {over(20)}"),
    },
)
window("bbw", lambda C, O, H, L, V: {"v": T.bbw(C, 20, 2.0)}, {"v": full(20, f"4 * stddev_pop(close) {over(20)} / avg(close) {over(20)}")})
window(
    "stdev",
    lambda C, O, H, L, V: {"v": T.stdev(C, 10), "sample": T.stdev(C, 10, False)},
    {"v": full(10, f"sqrt(avg(close * close) {over(10)} - (avg(close) {over(10)}) ** 2)"), "sample": full(10, f"stddev_samp(close) {over(10)}")},
)
window("variance", lambda C, O, H, L, V: {"v": T.variance(C, 10), "sample": T.variance(C, 10, False)}, {"v": full(10, f"var_pop(close) {over(10)}"), "sample": full(10, f"var_samp(close) {over(10)}")})
window("correlation", lambda C, O, H, L, V: {"v": T.correlation(C, V, 20)}, {"v": full(20, f"corr(close, volume) {over(20)}")})

# --- extrema, order statistics, pivots ---

window("highest", lambda C, O, H, L, V: {"v": T.highest(H, 20)}, {"v": full(20, f"max(high) {over(20)}")})
window("lowest", lambda C, O, H, L, V: {"v": T.lowest(L, 20)}, {"v": full(20, f"min(low) {over(20)}")})
window(
    "highestbars",
    lambda C, O, H, L, V: {"v": T.highestbars(H, 10)},
    {"v": full(10, "(list_position(list_reverse(l), list_max(l)) - 1)::DOUBLE")},
    ctes=f"\nm AS (SELECT *, list(high) {over(10)} AS l FROM bars)", source="m",
)
window(
    "lowestbars",
    lambda C, O, H, L, V: {"v": T.lowestbars(L, 10)},
    {"v": full(10, "(list_position(list_reverse(l), list_min(l)) - 1)::DOUBLE")},
    ctes=f"\nm AS (SELECT *, list(low) {over(10)} AS l FROM bars)", source="m",
)
window("run_max", lambda C, O, H, L, V: {"v": T.run_max(C)}, {"v": f"max(close) {over()}"})
window("run_min", lambda C, O, H, L, V: {"v": T.run_min(C)}, {"v": f"min(close) {over()}"})
window("median", lambda C, O, H, L, V: {"v": T.median(C, 9)}, {"v": full(9, f"median(close) {over(9)}")})
window(
    "mode",
    lambda C, O, H, L, V: {"v": T.mode(F.floor(C / 20).cast("double"), 9)},
    {"v": "CASE WHEN len(l) = 9 THEN list_sort(list_transform(list_distinct(l), lambda x: struct_pack(n := -len(list_filter(l, lambda y: y = x)), x := x)))[1].x END"},
    ctes=f"\nm AS (SELECT *, list(floor(close / 20)) {over(9)} AS l FROM bars)", source="m",
)
window("pctl_linear", lambda C, O, H, L, V: {"v": T.pct_linear(C, 10, 30)}, {"v": full(10, f"quantile_cont(close, 0.3) {over(10)}")})
window("pctl_nearest", lambda C, O, H, L, V: {"v": T.pct_nearest(C, 10, 35)}, {"v": full(10, f"list_sort(list(close) {over(10)})[4]")})
window(
    "percentrank",
    lambda C, O, H, L, V: {"v": T.percentrank(C, 10)},
    {"v": "CASE WHEN len(l) = 10 THEN 100.0 * (len(list_filter(l, lambda x: x <= close)) - 1) / 9 END"},
    ctes=f"\nm AS (SELECT *, list(close) {over(10)} AS l FROM bars)", source="m",
)
window("range", lambda C, O, H, L, V: {"v": T.range_(C, 10)}, {"v": full(10, f"max(close) {over(10)} - min(close) {over(10)}")})
window("rising", lambda C, O, H, L, V: {"is_up": T.rising(C, 3)}, {"is_up": f"coalesce(bar_index >= 2 AND close > {lag('close')} AND close > {lag('close', 2)}, false)"})
window("falling", lambda C, O, H, L, V: {"is_down": T.falling(C, 3)}, {"is_down": f"coalesce(bar_index >= 2 AND close < {lag('close')} AND close < {lag('close', 2)}, false)"})
window("pivothigh", lambda C, O, H, L, V: {"v": T.pivothigh(H, 3, 2)}, {"v": f"CASE WHEN count(high) {over(6)} = 6 AND {lag('high', 2)} >= max(high) {over(6)} THEN {lag('high', 2)} END"})
window("pivotlow", lambda C, O, H, L, V: {"v": T.pivotlow(L, 3, 2)}, {"v": f"CASE WHEN count(low) {over(6)} = 6 AND {lag('low', 2)} <= min(low) {over(6)} THEN {lag('low', 2)} END"})
window(
    "pivot_levels",
    lambda C, O, H, L, V: {n: F.get(T.pivot_levels(H, L, C), F.lit(i)) for i, n in enumerate(("p", "r1", "r2", "r3", "s1", "s2", "s3"))},
    {"p": "p", "r1": "2 * p - l", "r2": "p + h - l", "r3": "h + 2 * (p - l)", "s1": "2 * p - h", "s2": "p - h + l", "s3": "l - 2 * (h - p)"},
    ctes=f"""
y AS (SELECT *, coalesce({lag('high')}, high) AS h, coalesce({lag('low')}, low) AS l, coalesce({lag('close')}, close) AS c FROM bars),
q AS (SELECT *, (h + l + c) / 3 AS p FROM y)""",
    source="q",
)

# --- events and accumulators ---

_MA = f"\nm AS (SELECT *, {full(5, f'avg(close) {over(5)}')} AS ma FROM bars),\nx AS (SELECT *, close > ma AND {lag('close')} <= {lag('ma')} AS o, close < ma AND {lag('close')} >= {lag('ma')} AS u FROM m)"
window("crossover", lambda C, O, H, L, V: {"is_over": T.crossover(C, T.sma(C, 5))}, {"is_over": "coalesce(o, false)"}, ctes=_MA, source="x")
window("crossunder", lambda C, O, H, L, V: {"is_under": T.crossunder(C, T.sma(C, 5))}, {"is_under": "coalesce(u, false)"}, ctes=_MA, source="x")
window("cross", lambda C, O, H, L, V: {"is_cross": T.cross(C, T.sma(C, 5))}, {"is_cross": "coalesce(o, false) OR coalesce(u, false)"}, ctes=_MA, source="x")
window("barssince", lambda C, O, H, L, V: {"v": T.barssince(C > O)}, {"v": f"(bar_index - max(CASE WHEN close > open THEN bar_index END) {over()})::DOUBLE"})
window("cum", lambda C, O, H, L, V: {"v": T.cum(V)}, {"v": f"sum(volume) {over()}"}, digits=4)
window(
    "valuewhen",
    lambda C, O, H, L, V: {"v": T.valuewhen(C > O, C, 0), "second": T.valuewhen(C > O, C, 1)},
    {"v": "l[len(l)]", "second": "CASE WHEN len(l) > 1 THEN l[len(l) - 1] END"},
    ctes=f"\nm AS (SELECT *, list(close) FILTER (WHERE close > open) {over()} AS l FROM bars)", source="m",
)
window("history_index", lambda C, O, H, L, V: {"v": T.lag(C, 3), "sma_back": T.lag(T.sma(C, 4), 2)}, {"v": lag("close", 3), "sma_back": f"CASE WHEN bar_index >= 5 THEN avg(close) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) END"})
window("ffill", lambda C, O, H, L, V: {"v": T.ffill(F.when(C > O, C))}, {"v": f"last_value(CASE WHEN close > open THEN close END IGNORE NULLS) {over()}"})

# --- recursive indicators ---


def _ema(name: str, source: str, x: str, k: str, first: int = 0) -> str:
    return f"""
{name} AS (
  SELECT symbol, bar_index, {x} AS v FROM {source} WHERE bar_index = {first}
  UNION ALL
  SELECT s.symbol, s.bar_index, s.{x} * {k} + e.v * (1 - {k}) FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.bar_index = e.bar_index + 1)"""


def _rma(name: str, source: str, x: str, n: int) -> str:
    return f"""
{name} AS (
  SELECT symbol, {n - 1}::BIGINT AS bar_index, avg({x}) AS v FROM {source} WHERE bar_index < {n} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL
  SELECT s.symbol, s.bar_index, (e.v * {n - 1} + s.{x}) / {n} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.bar_index = e.bar_index + 1)"""


scanned("ema", [S.ema("close", 20, "v")], {"v": "CASE WHEN bar_index >= 19 THEN v END"}, ctes=_ema("e", "bars", "close", "(2.0 / 21)"), source="e")
scanned("rma", [S.rma("close", 14, "v")], {"v": "v"}, ctes=_rma("e", "bars", "close", 14), source="(SELECT b.symbol, b.bar_index, e.v FROM bars b LEFT JOIN e USING (symbol, bar_index))")
scanned("atr", [S.atr(14, "v")], {"v": "v"}, ctes=_TR + "," + _rma("e", "tr", "tr", 14), source="(SELECT b.symbol, b.bar_index, e.v FROM bars b LEFT JOIN e USING (symbol, bar_index))")
scanned(
    "macd",
    [S.macd("close", 12, 26, 9)],
    {"macd": "CASE WHEN bar_index >= 25 THEN m END", "signal": "CASE WHEN bar_index >= 33 THEN g END", "hist": "CASE WHEN bar_index >= 33 THEN m - g END"},
    ctes=_ema("f", "bars", "close", "(2.0 / 13)") + "," + _ema("s", "bars", "close", "(2.0 / 27)")
    + ",\nmm AS (SELECT f.symbol, f.bar_index, f.v - s.v AS m FROM f JOIN s USING (symbol, bar_index))," + _ema("gg", "mm", "m", "0.2", 25),
    source="(SELECT mm.*, gg.v AS g FROM mm LEFT JOIN gg USING (symbol, bar_index))",
)
_KC = _TR + "," + _ema("a", "tr", "close", "(2.0 / 21)") + "," + _ema("r", "tr", "tr", "(2.0 / 21)")
scanned(
    "kc",
    [S.kc("close", 20, 1.5)],
    {"kc_mid": "CASE WHEN bar_index >= 19 THEN m END", "kc_up": "CASE WHEN bar_index >= 19 THEN m + 1.5 * b END", "kc_low": "CASE WHEN bar_index >= 19 THEN m - 1.5 * b END"},
    ctes=_KC, source="(SELECT a.symbol, a.bar_index, a.v AS m, r.v AS b FROM a JOIN r USING (symbol, bar_index))",
)
scanned("kcw", [S.kcw("close", 20, 1.5)], {"kcw": "CASE WHEN bar_index >= 19 THEN 3 * b / m END"}, ctes=_KC, source="(SELECT a.symbol, a.bar_index, a.v AS m, r.v AS b FROM a JOIN r USING (symbol, bar_index))")
scanned(
    "tsi",
    [S.tsi("close", 13, 25)],
    {"tsi": "CASE WHEN den <> 0 THEN 100 * num / den END"},
    ctes=f"\nd AS (SELECT symbol, bar_index, close - {lag('close')} AS d, abs(close - {lag('close')}) AS ad FROM bars),"
    + _ema("d1", "d", "d", "(2.0 / 14)", 1) + "," + _ema("d2", "d1", "v", "(2.0 / 26)", 1) + "," + _ema("a1", "d", "ad", "(2.0 / 14)", 1) + "," + _ema("a2", "a1", "v", "(2.0 / 26)", 1),
    source="(SELECT b.symbol, b.bar_index, d2.v AS num, a2.v AS den FROM bars b LEFT JOIN d2 USING (symbol, bar_index) LEFT JOIN a2 USING (symbol, bar_index))",
)
scanned(
    "dmi",
    [S.dmi(14, 14)],
    {"plus_di": "CASE WHEN bar_index > 0 AND t <> 0 THEN 100 * p / t END", "minus_di": "CASE WHEN bar_index > 0 AND t <> 0 THEN 100 * m / t END", "adx": "adx"},
    ctes=_TR + f""",
mv AS (SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM tr),
s0 AS (
  SELECT symbol, bar_index, tr AS t, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m FROM mv WHERE bar_index = 0
  UNION ALL
  SELECT v.symbol, v.bar_index, s.t + (v.tr - s.t) / 14, s.p + ((CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END) - s.p) / 14,
         s.m + ((CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END) - s.m) / 14
  FROM s0 s JOIN mv v ON v.symbol = s.symbol AND v.bar_index = s.bar_index + 1),
dx AS (SELECT *, CASE WHEN p + m = 0 THEN 0 ELSE 100 * abs(p - m) / (p + m) END AS dx FROM s0),""" + _ema("ax", "dx", "dx", "(1.0 / 14)", 1),
    source="(SELECT s0.*, ax.v AS adx FROM s0 LEFT JOIN ax USING (symbol, bar_index))",
)
scanned(
    "sar",
    [S.sar(0.02, 0.02, 0.2)],
    {"sar": "sar"},
    ctes=f"""
pb AS (SELECT symbol, bar_index, high, low, {lag('high')} AS h1, {lag('low')} AS l1, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2 FROM bars),
st AS (
  SELECT symbol, 0::BIGINT AS bar_index, NULL::DOUBLE AS sar, NULL::DOUBLE AS ep, 0.02::DOUBLE AS af, NULL::BOOLEAN AS up FROM pb WHERE bar_index = 0
  UNION ALL
  SELECT symbol, bar_index,
    CASE WHEN flip THEN ep0 ELSE nx END, CASE WHEN flip THEN CASE WHEN up0 THEN low ELSE high END WHEN up0 THEN greatest(ep0, high) ELSE least(ep0, low) END,
    CASE WHEN flip THEN 0.02 WHEN (up0 AND high > ep0) OR (NOT up0 AND low < ep0) THEN least(af0 + 0.02, 0.2) ELSE af0 END, up0 <> flip
  FROM (SELECT *, CASE WHEN up0 THEN low < nx ELSE high > nx END AS flip
    FROM (SELECT *, CASE WHEN up0 THEN least(s0 + af0 * (ep0 - s0), l1, coalesce(l2, l1)) ELSE greatest(s0 + af0 * (ep0 - s0), h1, coalesce(h2, h1)) END AS nx
      FROM (SELECT p.*, coalesce(s.up, p.high >= p.h1) AS up0, s.af AS af0,
              coalesce(s.sar, CASE WHEN p.high >= p.h1 THEN l1 ELSE h1 END) AS s0, coalesce(s.ep, CASE WHEN p.high >= p.h1 THEN h1 ELSE l1 END) AS ep0
            FROM st s JOIN pb p ON p.symbol = s.symbol AND p.bar_index = s.bar_index + 1))))""",
    source="st",
)
scanned(
    "supertrend",
    [S.supertrend(3.0, 10)],
    {"supertrend": "CASE WHEN bar_index > 0 THEN CASE WHEN onu THEN u ELSE d END END", "direction": "CASE WHEN bar_index > 0 THEN CASE WHEN onu THEN -1.0 ELSE 1.0 END END"},
    ctes=_TR + "," + _ema("avg_tr", "tr", "tr", "0.1") + f""",
bd AS (SELECT b.symbol, b.bar_index, close, {lag('close')} AS c1, (high + low) / 2 + 3 * avg_tr.v AS bu, (high + low) / 2 - 3 * avg_tr.v AS bl
       FROM bars b JOIN avg_tr ON avg_tr.symbol = b.symbol AND avg_tr.bar_index = b.bar_index),
st AS (
  SELECT symbol, bar_index, bu AS u, bl AS d, true AS onu FROM bd WHERE bar_index = 0
  UNION ALL
  SELECT symbol, bar_index, nu, nd, CASE WHEN onu THEN close <= nu ELSE close < nd END
  FROM (SELECT b.symbol, b.bar_index, b.close, s.onu, CASE WHEN bu < s.u OR c1 > s.u THEN bu ELSE s.u END AS nu, CASE WHEN bl > s.d OR c1 < s.d THEN bl ELSE s.d END AS nd
        FROM st s JOIN bd b ON b.symbol = s.symbol AND b.bar_index = s.bar_index + 1))""".replace("lag(close, 1) OVER (PARTITION BY symbol ORDER BY bar_index)", "lag(close, 1) OVER (PARTITION BY b.symbol ORDER BY b.bar_index)"),
    source="st",
)

# --- other symbols ---

_ON = "LEFT JOIN (SELECT bar_index, {c} AS o FROM bars WHERE symbol = 'click') k USING (bar_index)"
joined("value_of", lambda b: X.value_of(b, "click", "volume", "v"), {"v": "o"}, source="bars " + _ON.format(c="volume"))
joined("close_of", lambda b: X.close_of(b, "click", "v"), {"v": "o"}, source="bars " + _ON.format(c="close"))
joined("open_of", lambda b: X.open_of(b, "click", "v"), {"v": "o"}, source="bars " + _ON.format(c="open"))
joined("high_of", lambda b: X.high_of(b, "click", "v"), {"v": "o"}, source="bars " + _ON.format(c="high"))
joined("low_of", lambda b: X.low_of(b, "click", "v"), {"v": "o"}, source="bars " + _ON.format(c="low"))
_TOP = "\nl AS (SELECT close, bar_index AS bi FROM bars WHERE symbol = 'click' ORDER BY bar_index DESC LIMIT {n})"
joined("sma_of", lambda b: X.sma_of(b, "click", 20, out="v"), {"v": "(SELECT avg(close) FROM l)"}, ctes=_TOP.format(n=20))
joined(
    "rsi_of",
    lambda b: X.rsi_of(b, "click", 14, out="v"),
    {"v": "(SELECT CASE WHEN sum(greatest(-d, 0)) = 0 THEN 100 ELSE 100 * sum(greatest(d, 0)) / sum(abs(d)) END FROM (SELECT close - lag(close) OVER (ORDER BY bi) AS d FROM l))"},
    ctes=_TOP.format(n=15),
)
joined("ema_of", lambda b: X.ema_of(b, "click", 20, out="v"), {"v": "(SELECT arg_max(v, bar_index) FROM e WHERE symbol = 'click')"}, ctes=_ema("e", "bars", "close", "(2.0 / 21)"))
