"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import windows as T
from barloom.registry import indicators, programs, values
from barloom.sources.bars import hourly_events


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with a moving average, bands and crosses, in one exchange by symbol."""
    close = F.col("close")
    mid, up, low = T.bb(close, 20, 2.0)
    return hourly_events(spark, sf_dir).select(
        "symbol", "bar_index", "bar_time", "close", mid.alias("sma"), up.alias("bb_up"), low.alias("bb_low"),
        T.crossover(close, T.sma(close, 20)).alias("crossed"),
    )


REGISTRIES = (indicators, values, programs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for r in REGISTRIES for k, v in r.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in REGISTRIES for k, v in r.SQL.items()}
