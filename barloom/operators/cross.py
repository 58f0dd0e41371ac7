"""Access to other symbols by bar position: the engine's only join-like operators.

The other symbol's bars are joined on bar_index; shorter series give na. Spark
broadcasts that side only if its size is under the session's threshold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K


def value_of(bars: DataFrame, other: str, value: str = "close", out: str | None = None, default: str = "close") -> DataFrame:
    """The bars with another symbol's value at the same position; a value type that bars lack falls back."""
    value = value if value in bars.columns else default
    side = bars.where(F.col("symbol") == other).select("bar_index", F.col(value).alias(out or f"{value}_of"))
    return bars.join(side, "bar_index", "left")


def close_of(bars: DataFrame, other: str, out: str = "close_of") -> DataFrame:
    return value_of(bars, other, "close", out)


def open_of(bars: DataFrame, other: str, out: str = "open_of") -> DataFrame:
    return value_of(bars, other, "open", out)


def high_of(bars: DataFrame, other: str, out: str = "high_of") -> DataFrame:
    return value_of(bars, other, "high", out)


def low_of(bars: DataFrame, other: str, out: str = "low_of") -> DataFrame:
    return value_of(bars, other, "low", out)


def sma_of(bars: DataFrame, other: str, n: int, value: str = "close", out: str = "sma_of") -> DataFrame:
    """One value for all bars: the mean of the last n values of the whole series; na if it is shorter."""
    last = bars.where(F.col("symbol") == other).orderBy(F.desc("bar_index")).limit(n)
    one = last.agg(F.when((F.count(value) == n) & (F.count("*") == n), F.avg(value)).alias(out))
    return bars.crossJoin(one)


def rsi_of(bars: DataFrame, other: str, n: int, value: str = "close", out: str = "rsi_of") -> DataFrame:
    """Simple-average RSI of the last n changes of the whole series; without losses 100, even when flat."""
    last = bars.where(F.col("symbol") == other).orderBy(F.desc("bar_index")).limit(n + 1)
    values = F.transform(F.array_sort(F.collect_list(F.struct("bar_index", F.col(value).alias("v")))), lambda x: x["v"])
    one = last.agg(values.alias("a"))
    d = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get("a", i) - F.get("a", i - 1))
    up = F.aggregate(d, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))
    down = F.aggregate(d, F.lit(0.0), lambda s, x: s + F.greatest(-x, F.lit(0.0)))
    value_ = F.when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("up", "down")))
    one = one.select(F.size("a").alias("n"), up.alias("up"), down.alias("down")).select(F.when(F.col("n") == n + 1, value_).alias(out))
    return bars.crossJoin(one)


def ema_of(bars: DataFrame, other: str, n: int, value: str = "close", out: str = "ema_of") -> DataFrame:
    """The last value of the exponential average over the whole series."""

    def run(table: pa.Table) -> pa.Table:
        step, v = K.Ema(n), None
        for x in table.sort_by("bar_index").column(value).to_pylist():
            v = step(x)
        return pa.table({out: pa.array([v], pa.float64())})

    side = bars.where(F.col("symbol") == other).select("symbol", "bar_index", F.col(value).cast("double").alias(value))
    one = side.groupBy("symbol").applyInArrow(run, f"{out} double").agg(F.max(out).alias(out))
    return bars.crossJoin(one)
