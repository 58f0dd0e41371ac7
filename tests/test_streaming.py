"""A stream gives what the batch gives."""

import os

from pyspark.sql import functions as F

from barloom.operators import scans as S
from barloom.streaming import replay, stream_bars, stream_scan

SCANS = [S.ema("close", 3, "ema"), S.macd("close", 2, 4, 2), S.tsi("close", 2, 3), S.dmi(3, 3), S.sar(0.02, 0.02, 0.2), S.supertrend(2.0, 3), S.atr(3), S.sma("close", 3), S.bb("close", 4, 2.0), S.correlation("close", "high", 3), S.highest("high", 3), S.lowest("low", 3)]


def _bars(spark, n=12):
    rows = [(s, i, float(10 + (i * k) % 7), float(8 - (i * k) % 3), float(9 + (i * k) % 5)) for s, k in (("A", 3), ("B", 5)) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, bar_index long, high double, low double, close double")


def test_stream_equals_batch(spark, tmp_path):
    bars = _bars(spark)
    for a in range(0, 12, 4):
        bars.where(F.col("bar_index").between(a, a + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    query = replay(bars, str(tmp_path / "in"), str(tmp_path / "check"), lambda s: stream_scan(s, *SCANS, order="bar_index"), lambda df, _: got.extend(df.collect()))
    query.awaitTermination()
    names = [o for s in SCANS for o in s.outputs]
    key = lambda r: (r.symbol, r.bar_index)
    expected = sorted(S.scan(bars, *SCANS).collect(), key=key)
    got.sort(key=key)
    assert [key(r) for r in got] == [key(r) for r in expected]
    for a, b in zip(got, expected, strict=True):
        for n in names:
            assert (a[n] is None and b[n] is None) or abs(a[n] - b[n]) < 1e-12, (n, a, b)


def test_stream_bars_drop_late_events(spark, tmp_path):
    """Bars come out once the watermark is past their end; an event later than the batch before's changes nothing."""
    hours = lambda h, m=0: f"2025-01-01 {h:02d}:{m:02d}:00"
    files = [
        [("A", hours(0, 5), 1.0), ("A", hours(0, 50), 3.0), ("A", hours(1, 5), 2.0), ("B", hours(1, 30), 7.0)],
        [("A", hours(5), 9.0)],
        [("A", hours(6), 8.0)],
        [("A", hours(0, 10), 100.0), ("A", hours(9), 4.0)],
    ]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        for file in (tmp_path / "in" / str(n)).iterdir():
            os.utime(file, (1_700_000_000 + 10 * n,) * 2)  # files come in by age
    got = []
    schema = spark.read.parquet(str(tmp_path / "in" / "0"))
    query = replay(schema, str(tmp_path / "in" / "*"), str(tmp_path / "check"), stream_bars, lambda df, _: got.extend(df.collect()))
    query.awaitTermination()
    bars = {(r.symbol, r.bar_time.hour): (r.open, r.high, r.low, r.close, r.volume) for r in got}
    assert bars["A", 0] == (1.0, 3.0, 1.0, 3.0, 2.0)
    assert bars["A", 1] == (2.0, 2.0, 2.0, 2.0, 1.0) and bars["B", 1] == (7.0, 7.0, 7.0, 7.0, 1.0)
    assert ("A", 9) not in bars
