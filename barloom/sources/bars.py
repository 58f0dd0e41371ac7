"""Bar sources: tables of (symbol, bar_index, bar_time, open, high, low, close, volume).

Event tables become bars by one partial aggregation; the shuffle carries one row
of a symbol, period and task. Only bars, not events, meet in the window that
numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "volume")


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with their position in each symbol, from 0, by time."""
    w = Window.partitionBy("symbol").orderBy("bar_time")
    return bars.withColumn("bar_index", F.row_number().over(w).cast("long") - 1)


def ohlcv(events: DataFrame, symbol: str = "event_type", time: str = "ts", value: str = "value", period: str = "hour") -> DataFrame:
    """Bars of an event table; times must be unique in a symbol for open and close to be defined."""
    at = F.date_trunc(period, F.col(time)).cast("timestamp_ntz")
    v = F.col(value).cast("double")
    bars = events.groupBy(F.col(symbol).alias("symbol"), at.alias("bar_time")).agg(
        F.min_by(v, time).alias("open"),
        F.max(v).alias("high"),
        F.min(v).alias("low"),
        F.max_by(v, time).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return numbered(bars)


def daily(facts: DataFrame, symbol: Column, day: str, value: str, volume: str) -> DataFrame:
    """Daily bars of a fact table whose rows tie on time: mean as open and close."""
    v = F.col(value).cast("double")
    bars = facts.groupBy(symbol.alias("symbol"), F.col(day).alias("bar_time")).agg(
        F.avg(v).alias("open"),
        F.max(v).alias("high"),
        F.min(v).alias("low"),
        F.avg(v).alias("close"),
        F.sum(F.col(volume).cast("double")).alias("volume"),
    )
    return numbered(bars)


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(spark.read.parquet(f"{sf_dir}/events.parquet"))


def derived(bars: DataFrame) -> DataFrame:
    """hl2, hlc3, hlcc4 and ohlc4; a price that the bars lack is taken from close."""
    has = set(bars.columns)
    o, h, l, c = (F.col(p if p in has else "close") for p in ("open", "high", "low", "close"))  # noqa: E741
    return bars.withColumns(
        {"hl2": (h + l) / 2, "hlc3": (h + l + c) / 3, "hlcc4": (h + l + c + c) / 4, "ohlc4": (o + h + l + c) / 4}
    )


class Catalog:
    """Symbols and value types of several sources; for a symbol the first source that has it wins."""

    def __init__(self):
        self.sources: list[DataFrame] = []

    def add(self, bars: DataFrame) -> Catalog:
        self.sources.append(bars)
        return self

    def bars(self) -> DataFrame:
        if not self.sources:
            raise ValueError("no source is registered")
        if len(self.sources) == 1:
            return self.sources[0]
        tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(self.sources)]
        every, owner = tagged[0], tagged[0].select("symbol", "_source")
        for t in tagged[1:]:
            every = every.unionByName(t, allowMissingColumns=True)
            owner = owner.unionByName(t.select("symbol", "_source"))
        owner = owner.groupBy("symbol").agg(F.min("_source").alias("_source"))
        return every.join(owner, ["symbol", "_source"], "left_semi").drop("_source")

    def symbols(self) -> DataFrame:
        return self.bars().select("symbol").distinct().orderBy("symbol")

    def value_types(self) -> list[str]:
        seen = {c for s in self.sources for c in s.columns}
        return sorted(seen.difference(("symbol", "bar_index", "bar_time")))
