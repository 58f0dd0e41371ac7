"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import catalog
from barloom.operators import kernels as K
from barloom.operators import scans as S
from barloom.operators import windows as T
from barloom.sources.bars import daily

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def many_symbols(spark: SparkSession) -> DataFrame:
    """Daily bars of each part: many symbols, so that indicators run in parallel."""
    facts = spark.read.parquet(f"{SF}/lineitem.parquet")
    return daily(facts, F.pmod(F.col("l_partkey"), F.lit(256)).cast("string"), "l_shipdate", "l_extendedprice", "l_quantity")


def windows(spark: SparkSession) -> DataFrame:
    out = S.scan(
        many_symbols(spark), S.sma("close", 20), S.bb("close", 20, 2.0), S.stdev("close", 20, out="sd"), S.correlation("close", "volume", 20, "co"),
        S.highest("close", 20, "hi"), S.lowest("close", 20, "lo"),
    )
    return out.select("symbol", "bar_index", "sma", "bb_mid", "bb_up", "bb_low", "sd", "co", "hi", "lo")


def window_columns(spark: SparkSession) -> DataFrame:
    """The same as Spark window expressions."""
    c, v = F.col("close"), F.col("volume")
    mid, up, low = T.bb(c, 20, 2.0)
    return many_symbols(spark).select(
        "symbol", "bar_index", T.sma(c, 20).alias("sma"), mid.alias("mid"), up.alias("up"), low.alias("low"), T.stdev(c, 20).alias("sd"), T.correlation(c, v, 20).alias("co"),
        T.highest(c, 20).alias("hi"), T.lowest(c, 20).alias("lo"),
    )


def streaming_bands() -> float:
    """Nanoseconds of one bar in the incremental Bollinger machine, 20 bars, after 400 others."""
    step = K.Sums(20, lambda s: s.bands(2.0))
    closes = [(i % 211 + 1) * 1.031 for i in range(200_400)]
    for x in closes[:400]:
        step(x)
    began = time.perf_counter()
    for x in closes[400:]:
        step(x)
    return (time.perf_counter() - began) / 200_000 * 1e9


def packed(spark: SparkSession) -> DataFrame:
    return S.scan(many_symbols(spark), S.ema("close", 20), S.macd("close", 12, 26, 9), S.dmi(14, 14), S.supertrend(3.0, 10))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    runs = {"bars_sma_bb_stdev_correlation": windows, "window_columns": window_columns, "packed_scan_pass": packed}
    runs |= {n: (lambda s, f=registered[n]: f(s, SF)) for n in ("bars_hourly", "bb", "rsi", "ema", "supertrend", "script_recursive_fisher", "array_stats")}
    bars = many_symbols(spark)
    bars.write.format("noop").mode("overwrite").save()
    count = bars.count()
    seconds = {}
    for name, f in runs.items():
        best = None
        for _ in range(2):
            began = time.time()
            f(spark).write.format("noop").mode("overwrite").save()
            took = time.time() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    rates = {n: round(count / seconds[n]) for n in ("bars_sma_bb_stdev_correlation", "window_columns", "packed_scan_pass")}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF, "bars": count, "bars_per_second": rates, "streaming_bands_ns_per_bar": round(streaming_bands())}))


if __name__ == "__main__":
    main()
