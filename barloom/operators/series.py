"""The series library: windows that look back from each bar, partial ones allowed, 0 when empty.

Every function takes Columns over bars ordered by position in a symbol. These
differ from the indicators: no warm-up, and 0 instead of na out of range.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.functions.na import div

from .windows import bars, lag, rows


def _list(x: Column, n: int) -> Column:
    """The last n values, oldest first."""
    return F.collect_list(x).over(rows(n))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def sum_(x: Column, n: int) -> Column:
    return F.coalesce(F.sum(x).over(rows(n)), F.lit(0.0))


def mean(x: Column, n: int) -> Column:
    return F.coalesce(F.avg(x).over(rows(n)), F.lit(0.0))


def maximum(x: Column, n: int) -> Column:
    return F.max(x).over(rows(n))


def minimum(x: Column, n: int) -> Column:
    return F.min(x).over(rows(n))


highest, lowest = maximum, minimum
abs_ = F.abs


def linear_regression(x: Column, n: int) -> tuple[Column, Column]:
    """(alpha, beta) with offsets counted back from now: alpha is the fitted value at this bar."""
    slope = F.regr_slope(x, F.col("bar_index")).over(rows(n))
    return F.regr_intercept(x, F.col("bar_index")).over(rows(n)) + slope * F.col("bar_index"), -slope


def predict(x: Column, n: int, offset: int = 1) -> Column:
    alpha, beta = linear_regression(x, n)
    return alpha - beta * offset


def next_cross(a: Column, b: Column, n: int) -> Column:
    """(bars, value, found): where the regression lines of a and b meet ahead."""
    a0, a1 = linear_regression(a, n)
    b0, b1 = linear_regression(b, n)
    ahead = div(b0 - a0, b1 - a1)  # values are alpha - beta * ahead
    found = F.coalesce(ahead > 0, F.lit(False))
    return F.struct(F.when(found, F.ceil(ahead)).otherwise(0).cast("double").alias("bars"), F.when(found, a0 - a1 * ahead).otherwise(0.0).alias("value"), found.alias("found"))


def array(x: Column, n: int) -> Column:
    """The last n values, newest first."""
    return F.reverse(_list(x, n))


def reverse(x: Column, n: int) -> Column:
    return _list(x, n)


def ols(a: Column, b: Column, n: int) -> tuple[Column, Column]:
    """(alpha, beta) of b on a; (0, 0) without variance."""
    return (F.coalesce(f(b, a).over(rows(n)), F.lit(0.0)) for f in (F.regr_intercept, F.regr_slope))


def rank(x: Column, n: int) -> Column:
    """1-based rank of the current value in its window, ties averaged."""
    held = _list(x, n)
    less, same = F.size(F.filter(held, lambda y: y < x)), F.size(F.filter(held, lambda y: y == x))
    return less + (same + 1) / 2


def change(x: Column, n: int = 1) -> Column:
    return F.coalesce(x - lag(x, n), F.lit(0.0))


def percentage_change(x: Column, n: int = 1) -> Column:
    return div(x, lag(x, n)) - 1


def stdev(x: Column, n: int, ddof: int = 0) -> Column:
    count = F.count(x).over(rows(n))
    return F.sqrt(div(F.var_pop(x).over(rows(n)) * count, count - ddof))


def variance(x: Column, n: int) -> Column:
    return F.var_pop(x).over(rows(n))


def covariance(a: Column, b: Column, n: int) -> Column:
    return F.covar_pop(a, b).over(rows(n))


def pearson(a: Column, b: Column, n: int) -> Column:
    return div(covariance(a, b, n), F.sqrt(variance(a, n) * variance(b, n)))


def auto_correlation(x: Column, n: int, back: int) -> Column:
    y = lag(x, back)
    return pearson(F.when(y.isNotNull(), x), y, n)


def skew(x: Column, n: int) -> Column:
    """Bias-corrected; na for fewer than 3 values."""
    count = F.count(x).over(rows(n))
    return F.when(count > 2, F.skewness(x).over(rows(n)) * F.sqrt(count * (count - 1)) / (count - 2))


def shift(x: Column, n: int) -> Column:
    """The value n bars back, or ahead for a negative n; 0 beyond the ends."""
    moved = F.lag(x, n).over(bars()) if n >= 0 else F.lead(x, -n).over(bars())
    return F.coalesce(moved, F.lit(0.0))


def rolling_group(n: int) -> Column:
    """Number of the window of n bars that a bar falls in, counted from the newest bar without overlap."""
    back = F.count("*").over(Window.partitionBy("symbol")) - 1 - F.col("bar_index")
    return F.floor(back / n)


def softmax(x: Column, n: int) -> Column:
    """The softmax of the window, oldest first."""
    held = _list(x, n)
    top = F.max(x).over(rows(n))
    e = F.zip_with(held, F.array_repeat(top, n), lambda v, m: F.exp(v - m))
    e = F.filter(e, lambda v: v.isNotNull())
    return F.zip_with(e, F.array_repeat(_sum(e), F.size(e)), lambda v, s: v / s)


def entropy(x: Column, n: int) -> Column:
    """Entropy of the window's values as they are; zeros add nothing, a negative one makes it na."""
    below = F.coalesce(F.min(x).over(rows(n)) < 0, F.lit(False))
    return F.when(~below, F.coalesce(F.sum(F.when(x > 0, -x * F.ln(x))).over(rows(n)), F.lit(0.0)))


def cross_entropy(a: Column, b: Column, n: int) -> Column:
    return F.sum(-a * F.ln(b)).over(rows(n))


def _pairs(a: Column, b: Column, n: int) -> Column:
    return F.collect_list(F.struct(a.alias("a"), b.alias("b"))).over(rows(n))


def kendall(a: Column, b: Column, n: int) -> Column:
    """Kendall's tau; ties count as discordant."""
    held = _pairs(a, b, n)
    count = F.size(held)
    one = F.transform(held, lambda p, i: _sum(F.transform(held, lambda q, j: F.when(j > i, F.when((p["a"] - q["a"]) * (p["b"] - q["b"]) > 0, 1.0).otherwise(-1.0)).otherwise(0.0))))
    return div(_sum(one), count * (count - 1) / 2)


def _ranks(held: Column, key: str) -> Column:
    less = lambda p: F.size(F.filter(held, lambda q: q[key] < p[key]))
    same = lambda p: F.size(F.filter(held, lambda q: q[key] == p[key]))
    return F.transform(held, lambda p: less(p) + (same(p) + 1) / 2)


def spearman(a: Column, b: Column, n: int) -> Column:
    """Pearson's correlation of ranks, ties averaged."""
    held = _pairs(a, b, n)
    ra, rb, count = _ranks(held, "a"), _ranks(held, "b"), F.size(held)
    mean_ = (count + 1) / 2
    co = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: (p - mean_) * (q - mean_)))
    return div(co(ra, rb), F.sqrt(co(ra, ra) * co(rb, rb)))


def correlation(a: Column, b: Column, n: int, kind: str = "pearson") -> Column:
    return {"pearson": pearson, "spearman": spearman, "kendall": kendall}[kind](a, b, n)


def dot(a: Column, b: Column, n: int) -> Column:
    return sum_(a * b, n)


def cross_over(a: Column, b: Column) -> Column:
    """Strict on both sides: below before, above now."""
    return F.coalesce((lag(a) < lag(b)) & (a > b), F.lit(False))


def cross_under(a: Column, b: Column) -> Column:
    return F.coalesce((lag(a) > lag(b)) & (a < b), F.lit(False))


def filter_series(df, cond: Column, n: int):
    """The newest n bars of each symbol for which ``cond`` holds."""
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_index"))
    return df.where(cond).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


add = lambda a, b: a + b
sub = lambda a, b: a - b
mul = lambda a, b: a * b
div_ = div
