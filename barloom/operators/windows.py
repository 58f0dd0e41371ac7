"""Indicators as window expressions: one exchange and one sort by symbol serve them all.

Rolling functions are na until the frame holds n
bars and whenever it holds an na.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.na import div, every


def bars() -> WindowSpec:
    """A symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("bar_index")


def sofar() -> WindowSpec:
    return bars().rowsBetween(Window.unboundedPreceding, 0)


def rows(n: int) -> WindowSpec:
    return bars().rowsBetween(-(n - 1), 0)


def full(src: Column, n: int, value: Column) -> Column:
    return F.when(F.count(src).over(rows(n)) == n, value)


def lag(src: Column, n: int = 1) -> Column:
    """``src[n]``: the value n bars ago; a negative n is an error."""
    if n < 0:
        raise ValueError("history index is negative")
    return src if n == 0 else F.lag(src, n).over(bars())


def frame(src: Column, n: int) -> Column:
    """The last n values, oldest first; na members are kept as NULL."""
    return F.transform(F.collect_list(F.struct(src.alias("v"))).over(rows(n)), lambda x: x["v"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _weighed(src: Column, weights: list[float]) -> Column:
    """Sum of weights (oldest first) times values."""
    n = len(weights)
    out = F.lit(weights[-1]) * src
    for i in range(1, n):
        out = out + F.lit(weights[n - 1 - i]) * lag(src, i)
    return out


def ffill(src: Column) -> Column:
    return F.last(src, ignorenulls=True).over(sofar())


# --- moving averages ---


def sma(src: Column, n: int) -> Column:
    return full(src, n, F.avg(src).over(rows(n)))


def wma(src: Column, n: int) -> Column:
    if n <= 32:
        return div(_weighed(src, [float(i + 1) for i in range(n)]), F.lit(n * (n + 1) / 2))
    terms = F.zip_with(frame(src, n), F.sequence(F.lit(1), F.lit(n)), lambda x, i: x * i)
    return full(src, n, _total(terms) / F.lit(n * (n + 1) / 2))


def swma(src: Column) -> Column:
    return _weighed(src, [1.0, 2.0, 2.0, 1.0]) / 6


def hma(src: Column, n: int) -> Column:
    half, root = max(1, n // 2), max(1, int(math.sqrt(n) + 0.5))
    return wma(2 * wma(src, half) - wma(src, n), root)


def alma(src: Column, n: int, offset: float = 0.85, sigma: float = 6.0, floor: bool = False) -> Column:
    m = offset * (n - 1)
    m = math.floor(m) if floor else m
    s = n / sigma
    weights = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]
    return _weighed(src, weights) / sum(weights)


def linreg(src: Column, n: int, offset: int = 0) -> Column:
    if n <= 1:
        return F.lit(None).cast("double")
    # Least squares on x = 0 .. n - 1 has closed weights.
    sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    den = n * sxx - sx * sx
    x0 = n - 1 - offset
    weights = [(sxx - sx * x) / den + x0 * (n * x - sx) / den for x in range(n)]
    return _weighed(src, weights)


def vwma(src: Column, volume: Column, n: int) -> Column:
    both = every(src, volume)
    return F.when(F.count(F.when(both, 1)).over(rows(n)) == n, div(F.sum(src * volume).over(rows(n)), F.sum(volume).over(rows(n))))


# --- oscillators ---


def change(src: Column, n: int = 1) -> Column:
    return src - lag(src, n)


def _moves(src: Column, n: int) -> tuple[Column, Column, Column]:
    d = change(src)
    up, down = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))
    return F.count(d).over(rows(n)) == n, F.sum(up).over(rows(n)), F.sum(down).over(rows(n))


def rsi(src: Column, n: int) -> Column:
    """Simple averages of gains and losses; flat gives 50, no loss 100."""
    ok, up, down = _moves(src, n)
    value = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + div(up, down)))
    return F.when(ok, value)


def cmo(src: Column, n: int) -> Column:
    ok, up, down = _moves(src, n)
    return F.when(ok, F.coalesce(div(100 * (up - down), up + down), F.lit(0.0)))


def dev(src: Column, n: int) -> Column:
    """Mean absolute deviation."""
    values = frame(src, n)
    mean = F.avg(src).over(rows(n))
    return full(src, n, F.aggregate(F.zip_with(values, F.array_repeat(mean, n), lambda x, m: F.abs(x - m)), F.lit(0.0), lambda a, x: a + x) / n)


def cci(src: Column, n: int) -> Column:
    d = dev(src, n)
    return F.when(d == 0, 0.0).otherwise(div(src - sma(src, n), 0.015 * d))


def cog(src: Column, n: int) -> Column:
    return div(-_weighed(src, [float(i + 1) for i in range(n)]), F.when(F.count(src).over(rows(n)) == n, F.sum(src).over(rows(n))))


def mom(src: Column, n: int) -> Column:
    return src - lag(src, n)


def roc(src: Column, n: int) -> Column:
    return div(100 * (src - lag(src, n)), lag(src, n))


def stoch(src: Column, high: Column, low: Column, n: int) -> Column:
    hh, ll = highest(high, n), lowest(low, n)
    return div(100 * (src - ll), hh - ll)


def mfi(src: Column, volume: Column, n: int) -> Column:
    d, flow = change(src), src * volume
    pos = F.sum(F.when(d > 0, flow).otherwise(0.0)).over(rows(n))
    neg = F.sum(F.when(d < 0, flow).otherwise(0.0)).over(rows(n))
    value = F.when(neg == 0, 100.0).when(pos == 0, 0.0).otherwise(100 - 100 / (1 + div(pos, neg)))
    return F.when(F.count(d).over(rows(n)) == n, value)


def wpr(high: Column, low: Column, close: Column, n: int) -> Column:
    hh, ll = highest(high, n), lowest(low, n)
    return div(-100 * (hh - close), hh - ll)


# --- bands and volatility ---


def tr(high: Column, low: Column, close: Column) -> Column:
    before = lag(close)
    wide = F.greatest(high - low, F.abs(high - before), F.abs(low - before))
    return F.when(before.isNull(), high - low).otherwise(wide)


def stdev(src: Column, n: int, biased: bool = True) -> Column:
    f = F.stddev_pop if biased else F.stddev_samp
    return full(src, n, f(src).over(rows(n)))


def variance(src: Column, n: int, biased: bool = True) -> Column:
    f = F.var_pop if biased else F.var_samp
    return full(src, n, f(src).over(rows(n)))


def bb(src: Column, n: int, mult: float) -> tuple[Column, Column, Column]:
    mid, d = sma(src, n), stdev(src, n)
    return mid, mid + mult * d, mid - mult * d


def bbw(src: Column, n: int, mult: float) -> Column:
    mid, up, low = bb(src, n, mult)
    return div(up - low, mid)


def correlation(a: Column, b: Column, n: int) -> Column:
    if n <= 1:
        return F.lit(None).cast("double")
    w = rows(n)
    both = F.count(F.when(every(a, b), 1)).over(w) == n
    return F.when(both, div(F.covar_pop(a, b).over(w), F.sqrt(F.var_pop(a).over(w) * F.var_pop(b).over(w))))


# --- extrema, order statistics, pivots ---


def highest(src: Column, n: int) -> Column:
    return full(src, n, F.max(src).over(rows(n)))


def lowest(src: Column, n: int) -> Column:
    return full(src, n, F.min(src).over(rows(n)))


def highestbars(src: Column, n: int) -> Column:
    """Bars since the highest value, the most recent of equals."""
    at = F.max_by("bar_index", F.struct(src, F.col("bar_index"))).over(rows(n))
    return full(src, n, (F.col("bar_index") - at).cast("double"))


def lowestbars(src: Column, n: int) -> Column:
    at = F.min_by("bar_index", F.struct(src, -F.col("bar_index"))).over(rows(n))
    return full(src, n, (F.col("bar_index") - at).cast("double"))


def run_max(src: Column) -> Column:
    return F.max(src).over(sofar())


def run_min(src: Column) -> Column:
    return F.min(src).over(sofar())


def median(src: Column, n: int) -> Column:
    return pct_linear(src, n, 50)


def mode(src: Column, n: int) -> Column:
    """Most frequent value, the smallest of equals."""
    return full(src, n, F.mode(src, True).over(rows(n)))


def pct_linear(src: Column, n: int, p: float) -> Column:
    return full(src, n, F.percentile(src, F.lit(p / 100)).over(rows(n)))


def pct_nearest(src: Column, n: int, p: float) -> Column:
    at = min(max(math.ceil(p / 100 * n), 1), n)
    return full(src, n, F.element_at(F.sort_array(frame(src, n)), at))


def percentrank(src: Column, n: int) -> Column:
    if n <= 1:
        return F.lit(None).cast("double")
    below = F.size(F.filter(F.zip_with(frame(src, n), F.array_repeat(src, n), lambda x, y: x <= y), lambda b: b))
    return full(src, n, 100.0 * (below - 1) / (n - 1))


def range_(src: Column, n: int) -> Column:
    return highest(src, n) - lowest(src, n)


def _before(n: int) -> WindowSpec:
    return bars().rowsBetween(-(n - 1), -1)


def rising(src: Column, n: int) -> Column:
    if n <= 1:
        return F.lit(False)
    return F.coalesce(full(src, n, src > F.max(src).over(_before(n))), F.lit(False))


def falling(src: Column, n: int) -> Column:
    if n <= 1:
        return F.lit(False)
    return F.coalesce(full(src, n, src < F.min(src).over(_before(n))), F.lit(False))


def pivothigh(src: Column, left: int, right: int) -> Column:
    at = lag(src, right)
    return F.when(at == highest(src, left + right + 1), at)


def pivotlow(src: Column, left: int, right: int) -> Column:
    at = lag(src, right)
    return F.when(at == lowest(src, left + right + 1), at)


def pivot_levels(high: Column, low: Column, close: Column) -> Column:
    """Classic [P, R1, R2, R3, S1, S2, S3] of the bar before; the first bar uses its own prices."""
    h, l, c = (F.coalesce(lag(x), x) for x in (high, low, close))  # noqa: E741
    p = (h + l + c) / 3
    return F.array(p, 2 * p - l, p + (h - l), h + 2 * (p - l), 2 * p - h, p - (h - l), l - 2 * (h - p))


# --- events and accumulators ---


def crossover(a: Column, b: Column) -> Column:
    return F.coalesce((lag(a) <= lag(b)) & (a > b), F.lit(False))


def crossunder(a: Column, b: Column) -> Column:
    return F.coalesce((lag(a) >= lag(b)) & (a < b), F.lit(False))


def cross(a: Column, b: Column) -> Column:
    return crossover(a, b) | crossunder(a, b)


def barssince(cond: Column) -> Column:
    return (F.col("bar_index") - F.max(F.when(cond, F.col("bar_index"))).over(sofar())).cast("double")


def cum(src: Column) -> Column:
    return F.sum(src).over(sofar())


def valuewhen(cond: Column, src: Column, occurrence: int = 0) -> Column:
    """``src`` at the occurrence-th most recent bar where ``cond`` held; 0 is the latest."""
    if occurrence == 0:
        return F.last(F.when(cond, F.struct(src.alias("v"))), ignorenulls=True).over(sofar())["v"]
    # Only the last occurrence + 1 matches are kept, so state stays bounded.
    held = F.collect_list(F.when(cond, F.struct(src.alias("v")))).over(sofar())
    return F.try_element_at(held, F.lit(-(occurrence + 1)))["v"]


