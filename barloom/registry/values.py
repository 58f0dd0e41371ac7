"""Registered queries of scalar, text, array, map, matrix and series functions, and of scripts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import collections as A
from barloom.functions import linalg, na
from barloom.functions import scalars as S
from barloom.operators import series as L
from barloom.operators import windows as T
from barloom.plans.engine import Engine
from barloom.sources.bars import Catalog, daily, hourly_events

from .indicators import BARS, P, full, lag, over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _bars(spark, sf_dir):
    return hourly_events(spark, sf_dir)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits=6):
    return F.round(c, digits)


# --- sources ---


@query(
    """SELECT l_returnflag || l_linestatus AS symbol, row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_shipdate) - 1 AS bar_index,
  round(avg(l_extendedprice), 8) AS close, max(l_extendedprice) AS high, min(l_extendedprice) AS low, round(sum(l_quantity), 4) AS volume
FROM lineitem GROUP BY l_returnflag || l_linestatus, l_shipdate"""
)
def bars_daily(spark, sf_dir):
    facts = _table(spark, sf_dir, "lineitem")
    bars = daily(facts, F.concat("l_returnflag", "l_linestatus"), "l_shipdate", "l_extendedprice", "l_quantity")
    return bars.select("symbol", "bar_index", _r("close", 8).alias("close"), "high", "low", _r("volume", 4).alias("volume"))


@query(
    """SELECT symbol, count(*) AS n FROM (
  SELECT event_type AS symbol FROM events GROUP BY event_type, date_trunc('hour', ts)
  UNION ALL SELECT l_returnflag || l_linestatus FROM lineitem GROUP BY l_returnflag || l_linestatus, l_shipdate) GROUP BY symbol"""
)
def catalog_symbols(spark, sf_dir):
    facts = _table(spark, sf_dir, "lineitem")
    bars = daily(facts, F.concat("l_returnflag", "l_linestatus"), "l_shipdate", "l_extendedprice", "l_quantity")
    both = Catalog().add(_bars(spark, sf_dir)).add(bars).add(_bars(spark, sf_dir))
    return both.bars().groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {BARS} SELECT symbol, arg_max(close, bar_index) AS close, max(bar_index) AS bar_index FROM bars GROUP BY symbol")
def snapshot(spark, sf_dir):
    return _bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "bar_index").alias("close"), F.max("bar_index").alias("bar_index"))


# --- scalars ---


@query(
    """SELECT p_partkey, trunc(x)::BIGINT AS as_int, x <> 0 AS as_bool, coalesce(y, 0) AS nz, y IS NULL AS is_na, greatest(x, 500) AS mx,
  CASE WHEN y IS NULL THEN NULL ELSE least(x, y) END AS mn, sign(x - 900) * floor(abs((x - 900) / 7) + 0.5) AS rnd, floor(x / 7) AS flo, ceil(x / 7) AS cei,
  round(power(x / 1000, 1.5), 6) AS pow, CASE WHEN x >= 950 THEN round(sqrt(greatest(x - 950, 0)), 6) END AS sqr, round(ln(x), 6) AS ln, round(log10(x), 6) AS lg,
  round((x + 2 + 7) / 3, 6) AS av, x + 2 + 7 AS su, round(exp(x / 1000), 6) AS ex, round(sin(x), 6) AS si, round(cos(x), 6) AS co, round(tan(x / 1000), 6) AS ta,
  CASE WHEN x <= 1000 THEN round(acos(least(x, 1000) / 1000), 6) END AS ac, CASE WHEN x <= 1000 THEN round(asin(least(x, 1000) / 1000), 6) END AS asi,
  round(atan(x), 6) AS at, sign(x - 950)::DOUBLE AS sg, round(degrees(x), 4) AS de, round(radians(x), 6) AS ra, x / nullif(p_size - 10, 0) AS quot,
  round(x - 950 - trunc((x - 950) / nullif(p_size - 10, 0)) * (p_size - 10), 6) AS rem, greatest(least(x, 1000), 920) AS clamped
FROM (SELECT p_partkey, p_size, p_retailprice AS x, CASE WHEN p_size > 25 THEN p_size::DOUBLE END AS y FROM part)"""
)
def math_scalars(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("x", F.col("p_retailprice").cast("double"))
    x = F.col("x")
    y = F.when(F.col("p_size") > 25, F.col("p_size").cast("double"))
    size = (F.col("p_size") - 10).cast("double")
    return p.select(
        "p_partkey", S.to_int(x).alias("as_int"), S.to_bool(x).alias("as_bool"), na.nz(y).alias("nz"), na.na(y).alias("is_na"),
        S.max_(x, F.lit(500.0)).alias("mx"), S.min_(x, y).alias("mn"), S.round_((x - 900) / 7).alias("rnd"), S.floor_(x / 7).alias("flo"), S.ceil_(x / 7).alias("cei"),
        _r(S.pow_(x / 1000, F.lit(1.5))).alias("pow"), _r(S.sqrt_(x - 950)).alias("sqr"), _r(S.log_(x)).alias("ln"), _r(S.log10_(x)).alias("lg"),
        _r(S.avg_(x, F.lit(2.0), F.lit(7.0))).alias("av"), S.sum_(x, F.lit(2.0), F.lit(7.0)).alias("su"), _r(S.exp_(x / 1000)).alias("ex"),
        _r(S.sin_(x)).alias("si"), _r(S.cos_(x)).alias("co"), _r(S.tan_(x / 1000)).alias("ta"), _r(S.acos_(x / 1000)).alias("ac"), _r(S.asin_(x / 1000)).alias("asi"),
        _r(S.atan_(x)).alias("at"), S.sign_(x - 950).alias("sg"), _r(S.todegrees(x), 4).alias("de"), _r(S.toradians(x)).alias("ra"),
        na.div(x, size).alias("quot"), _r(na.mod(x - 950, size)).alias("rem"), S.clamp(x, F.lit(920.0), F.lit(1000.0)).alias("clamped"),
    )


@query(None)
def math_random(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.random_(5, 2, seed=1).alias("v"))


@query(
    """SELECT doc_id, length(text)::DOUBLE AS n, upper(source) AS up, lower(upper(source)) AS low, contains(text, 'the') AS has, starts_with(text, 'T') AS st, ends_with(text, '.') AS en,
  replace(source, 's', '--') AS re, substring(source, 2, 2) AS sub, len(string_split(text, ' ')) AS words, string_split(source, 'r')[2] AS part,
  'doc ' || doc_id || ' {' || source || '} ' || round(n_chars / 8, 3)::DECIMAL(18, 3)::VARCHAR AS shown, '{9}' AS kept
FROM documents"""
)
def str_scalars(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    t, s = F.col("text"), F.col("source")
    shown = S.format_("doc {0,number,#} {{{1}}} {2,number,0.000}", F.col("doc_id").cast("double"), S.text_arg(s), F.col("n_chars") / 8)
    return d.select(
        "doc_id", S.length(t).alias("n"), S.upper(s).alias("up"), S.lower(S.upper(s)).alias("low"), S.contains(t, F.lit("the")).alias("has"),
        S.startswith(t, F.lit("T")).alias("st"), S.endswith(t, F.lit(".")).alias("en"), S.replace(s, F.lit("s"), F.lit("--")).alias("re"),
        S.substring(s, 1, 3).alias("sub"), F.size(S.split(t, " ")).cast("long").alias("words"), F.get(S.split(s, "r"), F.lit(1)).alias("part"),
        shown.alias("shown"), S.format_("{9}", s).alias("kept"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = trunc(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS q,
  CASE WHEN l_discount = 0 THEN '0' ELSE rtrim(l_discount::DECIMAL(9, 2)::VARCHAR, '0') END AS d FROM lineitem"""
)
def str_tostring(spark, sf_dir):
    x = _table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", S.to_text(F.col("l_quantity")).alias("q"), S.to_text(F.col("l_discount")).alias("d"))


# --- arrays, maps, matrices: over the last 8 closes of each bar ---

_W8 = f"WITH {BARS}, w AS (SELECT symbol, bar_index, list(close) {over(8)} AS a, list(volume) {over(8)} AS b FROM bars), v AS (SELECT * FROM w WHERE len(a) = 8)"


def _windows(spark, sf_dir):
    c, v = F.col("close"), F.col("volume")
    out = _bars(spark, sf_dir).select("symbol", "bar_index", T.frame(c, 8).alias("a"), T.frame(v, 8).alias("b"))
    return out.where(F.size("a") == 8)


@query(
    _W8
    + """ SELECT symbol, bar_index, round(list_sum(a), 6) AS s, round(list_avg(a), 6) AS av, list_max(a) AS mx, list_sort(a, 'DESC')[3] AS mx2, list_min(a) AS mn, list_sort(a)[2] AS mn1,
  round(list_max(a) - list_min(a), 6) AS rg, round((list_sort(a)[4] + list_sort(a)[5]) / 2, 6) AS med, round(list_sort(a)[2] + 0.75 * (list_sort(a)[3] - list_sort(a)[2]), 6) AS p25,
  list_sort(a)[3] AS pn, 100.0 * (len(list_filter(a, lambda x: x <= a[3])) - 1) / 7 AS pr, round((SELECT covar_pop(x, y) FROM (SELECT unnest(a) AS x, unnest(b) AS y)), 9) AS cov,
  len(list_filter(a, lambda x: x = 0)) = 0 AS ev, list_sort(list_transform(list_distinct(b), lambda x: struct_pack(n := -len(list_filter(b, lambda y: y = x)), x := x)))[1].x AS mo
FROM v"""
)
def array_stats(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _windows(spark, sf_dir).select(
        "symbol", "bar_index", _r(A.sum_(a)).alias("s"), _r(A.avg(a)).alias("av"), A.max_(a).alias("mx"), A.max_(a, 2).alias("mx2"), A.min_(a).alias("mn"), A.min_(a, 1).alias("mn1"),
        _r(A.range_(a)).alias("rg"), _r(A.median(a)).alias("med"), _r(A.percentile_linear(a, 25)).alias("p25"), A.percentile_nearest(a, 30).alias("pn"),
        A.percentrank(a, 2).alias("pr"), _r(A.covariance(a, b), 9).alias("cov"), A.every(a).alias("ev"), A.mode(b).alias("mo"),
    )


@query(
    _W8
    + """ SELECT symbol, bar_index, a[3] AS g, a[1] AS f, a[8] AS l, len(list_append(a, 1.5)) AS n, list_contains(a, a[4]) AS inc, list_position(b, b[8])::DOUBLE - 1 AS io,
  8 - list_position(list_reverse(b), b[1])::DOUBLE AS lio, round(list_sum(a[1:7]), 6) AS popped, round(list_sum(a[2:8]), 6) AS shifted, round(list_sum(a[3:5]), 6) AS sliced,
  round(list_sum(a) - a[5], 6) AS removed, round(list_sum(a) + 7, 6) AS inserted, round(list_sum(a) - a[2] + 3, 6) AS put, 16 AS cc, 0 AS cl, round(list_sum(list_transform(a, lambda x: abs(x - 0))), 6) AS ab,
  array_to_string([b[1]::BIGINT, b[2]::BIGINT], '|') AS j FROM v"""
)
def array_edit(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _windows(spark, sf_dir).select(
        "symbol", "bar_index", A.get(a, 2).alias("g"), A.first(a).alias("f"), A.last(a).alias("l"), F.size(A.push(a, 1.5)).cast("long").alias("n"), A.includes(a, A.get(a, 3)).alias("inc"),
        A.indexof(b, A.last(b)).alias("io"), A.lastindexof(b, A.first(b)).alias("lio"), _r(A.sum_(A.pop(a)[1])).alias("popped"), _r(A.sum_(A.shift(a)[1])).alias("shifted"),
        _r(A.sum_(A.slice_(a, 2, 5))).alias("sliced"), _r(A.sum_(A.remove(a, 4)[1])).alias("removed"), _r(A.sum_(A.insert(a, 3, 7.0))).alias("inserted"), _r(A.sum_(A.set_(a, 1, 3.0))).alias("put"),
        F.size(A.concat(a, b)).alias("cc"), F.size(A.clear(a)).alias("cl"), _r(A.sum_(A.abs_(a))).alias("ab"), A.join(A.slice_(b, 0, 2), "|").alias("j"),
    )


@query(
    """SELECT p_partkey, 3.0 AS n, p_size::DOUBLE AS got, p_brand <> 'zz' AS has, ['a', 'b', p_brand] AS ks, [1.0, 2.0, p_size::DOUBLE] AS vs, 2.0 AS less, NULL::DOUBLE AS none, 0.0 AS cleared
FROM (SELECT p_partkey, p_size, 'x' || p_brand AS p_brand FROM part)"""
)
def map_ops(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("p_brand", F.concat(F.lit("x"), F.col("p_brand")))
    m = A.map_put(A.map_put(A.map_put(A.map_put(A.map_new(), "b", 2.0), "a", 9.0), F.col("p_brand"), F.col("p_size").cast("double")), "a", 1.0)
    return p.select(
        "p_partkey", A.map_size(m).alias("n"), A.map_get(m, F.col("p_brand")).alias("got"), A.map_contains(m, F.col("p_brand")).alias("has"), A.map_keys(m).alias("ks"), A.map_values(m).alias("vs"),
        A.map_size(A.map_remove(m, "b")).alias("less"), A.map_get(m, "zz").alias("none"), A.map_size(A.map_clear(m)).alias("cleared"),
    )


_M = _W8 + ", q AS (SELECT symbol, bar_index, a[1] AS p, a[2] AS q, a[3] AS r, a[4] AS s FROM v)"


def _matrix(spark, sf_dir):
    a = [F.get("a", F.lit(i)) for i in range(4)]
    return _windows(spark, sf_dir).withColumn("m", A.m_from(a[:2], a[2:]))


@query(
    _M
    + """ SELECT symbol, bar_index, 2 AS nr, 2 AS nc, 4 AS cnt, q AS g, [r, s] AS ro, [q, s] AS co, flatten([[p, r], [q, s]]) AS tr, flatten([[s, r], [q, p]]) AS rev, [p, q, r, s] AS re,
  flatten([[p, q], [9.0, s]]) AS se, flatten([[r, s], [p, q]]) AS sw, flatten([[q, p], [s, r]]) AS sc, flatten([[p, q, 1.0], [r, s, 2.0]]) AS ac, flatten([[1.0, 2.0], [p, q], [r, s]]) AS ar, flatten([[r, s]]) AS rr, flatten([[q], [s]]) AS rc,
  round(p + s, 6) AS trace, round(p + q + r + s, 6) AS su, round((p + q + r + s) / 4, 6) AS av, greatest(p, q, r, s) AS mx, flatten([[p, q, p, q], [r, s, r, s]]) AS cc, flatten([[0.0, 0.0], [0.0, 0.0]]) AS di,
  flatten([[round(p * p + q * r, 4), round(p * q + q * s, 4)], [round(r * p + s * r, 4), round(r * q + s * s, 4)]]) AS mu, list_sort([p, q, r, s]) AS so, flatten([[q], [s]]) AS sm FROM q"""
)
def matrix_basic(spark, sf_dir):
    m = F.col("m")
    flat = lambda x: F.flatten(x)
    rounded = F.transform(A.m_mult(m, m), lambda row: F.transform(row, lambda x: F.round(x, 4)))
    pair = lambda x, y: F.array(F.lit(x), F.lit(y))
    return _matrix(spark, sf_dir).select(
        "symbol", "bar_index", A.m_rows(m).alias("nr"), A.m_cols(m).alias("nc"), A.m_count(m).alias("cnt"), A.m_get(m, 0, 1).alias("g"), A.m_row(m, 1).alias("ro"), A.m_col(m, 1).alias("co"),
        flat(A.m_transpose(m)).alias("tr"), flat(A.m_reverse(m)).alias("rev"), flat(A.m_reshape(m, 1, 4)).alias("re"), flat(A.m_set(m, 1, 0, 9.0)).alias("se"), flat(A.m_swap_rows(m, 0, 1)).alias("sw"),
        flat(A.m_swap_cols(m, 0, 1)).alias("sc"), flat(A.m_add_col(m, pair(1.0, 2.0))).alias("ac"), flat(A.m_add_row(m, pair(1.0, 2.0), 0)).alias("ar"), flat(A.m_remove_row(m, 0)).alias("rr"), flat(A.m_remove_col(m, 0)).alias("rc"),
        _r(A.m_trace(m)).alias("trace"), _r(A.m_stat(m, A.sum_)).alias("su"), _r(A.m_stat(m, A.avg)).alias("av"), A.m_stat(m, A.max_).alias("mx"), flat(A.m_concat(m, m)).alias("cc"), flat(A.m_diff(m, m)).alias("di"),
        flat(rounded).alias("mu"), flat(A.m_sort(m)).alias("so"), flat(A.m_sub(m, 0, 2, 1, 2)).alias("sm"),
    )


@query(
    _M
    + """ SELECT symbol, bar_index, round(p * s - q * r, 7) AS det, CASE WHEN abs(p * s - q * r) < 1e-9 THEN 1.0 ELSE 2.0 END AS rank, true AS sq, abs(q - r) <= 1e-9 AS sy,
  abs(q) <= 1e-9 AND abs(r) <= 1e-9 AS dia, abs(q) <= 1e-9 OR abs(r) <= 1e-9 AS tri, false AS zero, false AS ide, round(x1, 3) AS e1, round(x2, 3) AS e2
FROM (SELECT *, p + 400 + sqrt(10000 + (q + r) ** 2 / 4) AS x1, p + 400 - sqrt(10000 + (q + r) ** 2 / 4) AS x2 FROM q)"""
)
def matrix_linalg(spark, sf_dir):
    a = [F.get("a", F.lit(i)) for i in range(4)]
    m = F.col("m")
    half = (a[1] + a[2]) / 2
    df = _matrix(spark, sf_dir).withColumn("y", A.m_from([a[0] + 500, half], [half, a[0] + 300])).withColumn("e", linalg.eigenvalues_col(F.col("y")))
    return df.select(
        "symbol", "bar_index", _r(linalg.det_col(m), 7).alias("det"), linalg.rank_col(m).alias("rank"), A.m_is(m, "square").alias("sq"), A.m_is(m, "symmetric").alias("sy"), A.m_is(m, "diagonal").alias("dia"),
        A.m_is(m, "triangular").alias("tri"), A.m_is(m, "zero").alias("zero"), A.m_is(m, "identity").alias("ide"),
        _r(F.get("e", F.lit(0)), 3).alias("e1"), _r(F.get("e", F.lit(1)), 3).alias("e2"),
    )


# --- time ---


@query(
    f"""WITH {BARS} SELECT symbol, bar_index, (bar_index + 1) % 4 = 0 AS changed, (1735689600000 + bar_index * 3600000)::DOUBLE AS t, (1735689600000 + (bar_index + 1) * 3600000)::DOUBLE AS tc,
  (1735689600000 + bar_index // 24 * 86400000)::DOUBLE AS day, year(o)::DOUBLE AS year, month(o)::DOUBLE AS month, day(o)::DOUBLE AS dayofmonth, (dayofweek(o) + 1)::DOUBLE AS dayofweek,
  hour(o)::DOUBLE AS hour, minute(o)::DOUBLE AS minute, second(o)::DOUBLE AS second, 86400.0 AS secs, '1W' AS named FROM (SELECT *, make_timestamp((1735689600000 + bar_index * 3600000) * 1000) AS o FROM bars)"""
)
def time_parts(spark, sf_dir):
    i = F.col("bar_index")
    df = _bars(spark, sf_dir).withColumn("o", S.bar_open(i, datetime(2025, 1, 1), "60"))
    o = F.col("o")
    return df.select(
        "symbol", "bar_index", S.timeframe_change(i, "60", "240").alias("changed"), S.time_(o).alias("t"), S.time_close(o, "60").alias("tc"), S.time_tradingday(o).alias("day"),
        *(c.alias(n) for n, c in S.parts(o).items()), F.lit(S.in_seconds("1D")).alias("secs"), F.lit(S.from_seconds(604800)).alias("named"),
    )


# --- series library ---


@query(
    f"""WITH {BARS}, w AS (SELECT *, list(close) {over(6)} AS a, list(volume) {over(6)} AS b, regr_slope(close, bar_index) {over(6)} AS m, regr_intercept(close, bar_index) {over(6)} AS k FROM bars)
SELECT symbol, bar_index, round(list_sum(a), 6) AS s, round(list_avg(a), 6) AS av, list_max(a) AS hi, list_min(a) AS lo, round(k + m * (bar_index + 1), 5) AS pred,
  len(list_filter(a, lambda x: x < close)) + (len(list_filter(a, lambda x: x = close)) + 1) / 2 AS rk, round(coalesce(close - {lag('close', 2)}, 0), 6) AS ch, round(close / nullif({lag('close')}, 0) - 1, 6) AS pc,
  round(stddev_pop(close) {over(6)}, 6) AS sd, round(var_pop(close) {over(6)}, 6) AS va, round(covar_pop(close, volume) {over(6)}, 6) AS co, coalesce({lag('close', 2)}, 0) AS sh,
  coalesce(lead(close) OVER ({P}), 0) AS le, list_reverse(a) AS arr, round(1 / (1 + exp(-close / 100)), 6) AS sig, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 4) AS dot,
  floor((count(*) OVER (PARTITION BY symbol) - 1 - bar_index) / 5)::BIGINT AS grp, coalesce({lag('close')} < {lag('open')} AND close > open, false) AS xo FROM w"""
)
def series_windows(spark, sf_dir):
    c, v, o = F.col("close"), F.col("volume"), F.col("open")
    return _bars(spark, sf_dir).select(
        "symbol", "bar_index", _r(L.sum_(c, 6)).alias("s"), _r(L.mean(c, 6)).alias("av"), L.highest(c, 6).alias("hi"), L.lowest(c, 6).alias("lo"), _r(L.predict(c, 6), 5).alias("pred"),
        L.rank(c, 6).alias("rk"), _r(L.change(c, 2)).alias("ch"), _r(L.percentage_change(c)).alias("pc"), _r(L.stdev(c, 6)).alias("sd"), _r(L.variance(c, 6)).alias("va"), _r(L.covariance(c, v, 6)).alias("co"),
        L.shift(c, 2).alias("sh"), L.shift(c, -1).alias("le"), L.array(c, 6).alias("arr"), _r(L.sigmoid(c / 100)).alias("sig"), _r(L.dot(c, v, 6), 4).alias("dot"), L.rolling_group(5).alias("grp"), L.cross_over(c, o).alias("xo"),
    )


@query(
    f"""WITH {BARS}, w AS (SELECT *, list(struct_pack(a := close, b := volume)) {over(6)} AS l, list(close) {over(6)} AS a, list(volume) {over(6)} AS b, {lag('close')} AS c1 FROM bars),
r AS (SELECT *, list_transform(a, lambda x: len(list_filter(a, lambda y: y < x)) + (len(list_filter(a, lambda y: y = x)) + 1) / 2) AS ra,
  list_transform(b, lambda x: len(list_filter(b, lambda y: y < x)) + (len(list_filter(b, lambda y: y = x)) + 1) / 2) AS rb FROM w)
SELECT symbol, bar_index, {full(6, f"round(corr(close, volume) {over(6)}, 6)")} AS pe,
  CASE WHEN len(a) = 6 THEN round((SELECT covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) FROM (SELECT unnest(ra) AS x, unnest(rb) AS y)), 6) + 0 END AS sp,
  CASE WHEN len(a) = 6 THEN round(list_sum(list_transform(range(1, 7), lambda i: list_sum(list_transform(range(1, 7), lambda j: CASE WHEN j <= i THEN 0 WHEN (a[i] - a[j]) * (b[i] - b[j]) > 0 THEN 1 ELSE -1 END)))) / 15, 6) END AS ke,
  CASE WHEN len(a) = 6 THEN round(list_avg(list_transform(a, lambda x: (x - list_avg(a)) ** 3)) / power(list_avg(list_transform(a, lambda x: (x - list_avg(a)) ** 2)), 1.5) * sqrt(30) / 4, 5) END AS sk,
  CASE WHEN len(a) = 6 THEN round(exp(close - list_max(a)) / list_sum(list_transform(a, lambda x: exp(x - list_max(a)))), 6) END AS so, round(list_sum(list_transform(b, lambda x: -x * ln(x))), 4) AS en
FROM r"""
)
def series_statistics(spark, sf_dir):
    c, v = F.col("close"), F.col("volume")
    ok = F.col("bar_index") >= 5
    return _bars(spark, sf_dir).select(
        "symbol", "bar_index", F.when(ok, _r(L.pearson(c, v, 6))).alias("pe"), F.when(ok, _r(L.spearman(c, v, 6)) + 0).alias("sp"), F.when(ok, _r(L.kendall(c, v, 6))).alias("ke"),
        F.when(ok, _r(L.skew(c, 6), 5)).alias("sk"), F.when(ok, _r(F.element_at(L.softmax(c, 6), -1))).alias("so"), _r(L.entropy(v, 6), 4).alias("en"),
    )


@query(f"WITH {BARS} SELECT symbol, bar_index, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_index DESC) AS r FROM bars WHERE close > 50) WHERE r <= 12")
def series_filter(spark, sf_dir):
    return L.filter_series(_bars(spark, sf_dir), F.col("close") > 50, 12).select("symbol", "bar_index", "close")


# --- conditions, alerts ---


@query(
    f"""WITH {BARS} SELECT symbol, bar_index, CASE WHEN close > open THEN 1.0 WHEN close < open THEN -1.0 ELSE 0.0 END AS tern, coalesce(close > {lag('close')}, false) AS gt,
  NOT coalesce(close = {lag('close')}, false) AS ne, CASE hour(bar_time) WHEN 0 THEN 'open' WHEN 23 THEN 'close' ELSE 'mid' END AS sw FROM bars"""
)
def ternary_switch(spark, sf_dir):
    c, o = F.col("close"), F.col("open")
    hour = F.hour("bar_time")
    return _bars(spark, sf_dir).select(
        "symbol", "bar_index", F.when(na.lt(o, c), 1.0).when(na.lt(c, o), -1.0).otherwise(0.0).alias("tern"), na.lt(T.lag(c), c).alias("gt"), na.ne(c, T.lag(c)).alias("ne"),
        F.when(hour == 0, "open").when(hour == 23, "close").otherwise("mid").alias("sw"),
    )


# --- scripts ---


def _engine(spark, sf_dir) -> Engine:
    return Engine(start=datetime(2025, 1, 1)).register_source(_bars(spark, sf_dir))


@query(f"WITH {BARS} SELECT symbol, bar_index, 'close ' || CASE WHEN close > 90 THEN 'high' END AS message FROM bars WHERE close > 90")
def script_alerts(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return e.execute(e.compile("alertcondition(close > 90, 'level', 'close high')")).alerts().select("symbol", "bar_index", "message")


@query(
    f"""WITH {BARS} SELECT symbol, bar_index, round(CASE WHEN bar_index >= 19 THEN (close - avg(close) {over(20)}) / nullif(stddev_pop(close) {over(20)}, 0) END, 6) AS value FROM bars"""
)
def script_straightline(spark, sf_dir):
    e = _engine(spark, sf_dir)
    code = "score(src, len) =>\n    m = ta.sma(src, len)\n    d = ta.stdev(src, len)\n    (src - m) / d\nscore(close, 20)"
    return e.execute(e.compile(code)).df.select("symbol", "bar_index", _r("value").alias("value"))


@query(
    f"""WITH RECURSIVE {BARS}, x AS (SELECT symbol, bar_index, (high + low) / 2 AS p, max(high) {over(9)} AS hh, min(low) {over(9)} AS ll, count(*) {over(9)} AS n FROM bars),
f AS (
  SELECT symbol, bar_index, 0.0::DOUBLE AS v, 0.0::DOUBLE AS fish FROM x WHERE bar_index = 0
  UNION ALL
  SELECT symbol, bar_index, v, 0.5 * ln((1 + v) / (1 - v)) + 0.5 * old FROM (
    SELECT x.symbol, x.bar_index, f.fish AS old,
      greatest(least(CASE WHEN n < 9 OR hh = ll THEN 0.67 * f.v ELSE 0.66 * ((p - ll) / (hh - ll) - 0.5) + 0.67 * f.v END, 0.999), -0.999) AS v
    FROM f JOIN x ON x.symbol = f.symbol AND x.bar_index = f.bar_index + 1))
SELECT symbol, bar_index, round(fish, 6) AS value FROM f"""
)
def script_recursive_fisher(spark, sf_dir):
    code = """
hh = ta.highest(high, 9)
ll = ta.lowest(low, 9)
raw = nz(0.66 * ((hl2 - ll) / (hh - ll) - 0.5))
value = 0.0
value := bar_index == 0 ? 0.0 : math.max(math.min(raw + 0.67 * nz(value[1]), 0.999), -0.999)
fish = 0.0
fish := 0.5 * math.log((1 + value) / (1 - value)) + 0.5 * nz(fish[1])
fish
"""
    e = _engine(spark, sf_dir)
    return e.execute(e.compile(code)).df.select("symbol", "bar_index", _r("value").alias("value"))


@query(
    f"""WITH {BARS} SELECT b.symbol, b.bar_index, round(b.close - k.close + greatest(floor(b.volume), 0) % 3, 6) AS value
FROM bars b LEFT JOIN (SELECT bar_index, close FROM bars WHERE symbol = 'click') k USING (bar_index)"""
)
def script_cross_symbol(spark, sf_dir):
    e = _engine(spark, sf_dir).register_function("left", lambda v: v % 3, ["v"])
    return e.execute(e.compile("close - close_of('click') + left(v = math.floor(volume))")).df.select("symbol", "bar_index", _r("value").alias("value"))


@query(f"WITH {BARS} SELECT symbol, sum(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS value FROM bars GROUP BY symbol")
def script_accumulator(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return e.execute(e.compile("if bar_index == 0\n    n = 0.0\nif close > open\n    n += 1\nn + 0")).last()


@query(f"WITH {BARS} SELECT symbol, bar_index, 'at ' || bar_index AS message FROM bars WHERE bar_index % 10 = 0")
def script_logs(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return e.execute(e.compile("if bar_index % 10 == 0\n    log.info('at {0,number,#}', bar_index)")).logs().select("symbol", "bar_index", "message")
