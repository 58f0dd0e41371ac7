"""Recursive indicators in batch: one grouped pass by symbol runs every machine asked for.

``scan`` packs any number of machines into a single ``applyInArrow`` pass, so a
query with ema, macd, dmi and supertrend shuffles and sorts its bars once.
Machines that have a form over whole columns use it where no value is na. If all
look back a bounded number of bars, a symbol is cut into segments that overlap
by that number, so a long symbol runs in parallel and in bounded memory;
otherwise memory is one symbol's bars. ``affine`` runs ema and rma as a fold
inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import rolling as V

#: Bars of a segment.
SEGMENT = 1 << 16


@dataclass(frozen=True)
class Scan:
    """One machine: its inputs (column names), how it is made, and its outputs.

    ``batch`` is its form over whole columns, ``span`` the number of earlier bars
    that a value depends on, if bounded.
    """

    make: Callable
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    batch: Callable | None = None
    span: int | None = None


def sma(src: str, n: int, out: str = "sma") -> Scan:
    return Scan(lambda: K.Sums(n, K.Sums.mean), (src,), (out,), V.sma(n), max(0, n - 1))


def stdev(src: str, n: int, biased: bool = True, out: str = "stdev") -> Scan:
    return Scan(lambda: K.Sums(n, lambda s: s.stdev(biased)), (src,), (out,), V.stdev(n, biased), max(0, n - 1))


def bb(src: str, n: int, mult: float, out: tuple[str, str, str] = ("bb_mid", "bb_up", "bb_low")) -> Scan:
    def make():
        inner = K.Sums(n, lambda s: s.bands(mult))
        return K.Listed(inner, 3)

    return Scan(make, (src,), out, V.bb(n, mult), max(0, n - 1))


def correlation(a: str, b: str, n: int, out: str = "correlation") -> Scan:
    return Scan(lambda: K.Sums(n if n > 1 else 0, K.Sums.correlation), (a, b), (out,), V.correlation(n), max(0, n - 1))


def highest(src: str, n: int, out: str = "highest") -> Scan:
    return Scan(lambda: K.Extreme(n), (src,), (out,), V.highest(n), max(0, n - 1))


def lowest(src: str, n: int, out: str = "lowest") -> Scan:
    return Scan(lambda: K.Extreme(n, -1.0), (src,), (out,), V.lowest(n), max(0, n - 1))


def ema(src: str, n: int, out: str = "ema") -> Scan:
    return Scan(lambda: K.Ema(n), (src,), (out,), V.ema(n))


def rma(src: str, n: int, out: str = "rma") -> Scan:
    return Scan(lambda: K.Rma(n), (src,), (out,), V.rma(n))


def atr(n: int, out: str = "atr") -> Scan:
    return Scan(lambda: K.Atr(n), ("high", "low", "close"), (out,), V.atr(n))


def macd(src: str, fast: int, slow: int, signal: int, out: tuple[str, str, str] = ("macd", "signal", "hist")) -> Scan:
    return Scan(lambda: K.Macd(fast, slow, signal), (src,), out, V.macd(fast, slow, signal))


def kc(src: str, n: int, mult: float, use_tr: bool = True, out: tuple[str, str, str] = ("kc_mid", "kc_up", "kc_low")) -> Scan:
    return Scan(lambda: K.Kc(n, mult, use_tr), (src, "high", "low", "close"), out)


def kcw(src: str, n: int, mult: float, use_tr: bool = True, out: str = "kcw") -> Scan:
    def make():
        inner = K.Kc(n, mult, use_tr)

        def step(*x):
            mid, up, low = inner(*x)
            return (up - low) / mid if mid else None

        return step

    return Scan(make, (src, "high", "low", "close"), (out,))


def tsi(src: str, short: int, long: int, out: str = "tsi") -> Scan:
    return Scan(lambda: K.Tsi(short, long), (src,), (out,))


def dmi(n: int, smooth: int, out: tuple[str, str, str] = ("plus_di", "minus_di", "adx")) -> Scan:
    return Scan(lambda: K.Dmi(n, smooth), ("high", "low", "close"), out, V.dmi(n, smooth))


def sar(start: float, step: float, most: float, out: str = "sar") -> Scan:
    return Scan(lambda: K.Sar(start, step, most), ("high", "low"), (out,))


def supertrend(factor: float, n: int, out: tuple[str, str] = ("supertrend", "direction")) -> Scan:
    return Scan(lambda: K.Supertrend(factor, n), ("high", "low", "close"), out, V.supertrend(factor, n))


def scan(bars: DataFrame, *scans: Scan) -> DataFrame:
    """The bars with the outputs of all scans; outputs replace columns of their names."""
    new = [o for s in scans for o in s.outputs]
    bars = bars.drop(*new)
    schema = T.StructType([*bars.schema.fields, *(T.StructField(o, T.DoubleType()) for o in new)])

    spans = [s.span for s in scans]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_index")
        names = {i for s in scans for i in s.inputs}
        arrays = {c: table.column(c).cast(pa.float64()).to_numpy() for c in names if not table.column(c).null_count}
        lists = {}
        for s in scans:
            whole = s.batch is not None and all(i in arrays and not np.isnan(arrays[i]).any() for i in s.inputs)
            columns = s.batch(*(arrays[i] for i in s.inputs)) if whole else None
            if columns is not None:
                columns = [pa.array(c, pa.float64(), from_pandas=True) for c in columns]
            else:
                step = s.make()
                lists |= {i: table.column(i).to_pylist() for i in s.inputs if i not in lists}
                got = [step(*row) for row in zip(*(lists[i] for i in s.inputs), strict=True)]
                columns = [got] if len(s.outputs) == 1 else list(zip(*got, strict=True))
                columns = [pa.array(c, pa.float64()) for c in columns]
            for name, column in zip(s.outputs, columns, strict=True):
                table = table.append_column(name, column)
        return table

    if not scans or None in spans:
        return bars.groupBy("symbol").applyInArrow(run, schema)
    size, index = max(SEGMENT, max(spans)), F.col("bar_index")
    # The last bars of a segment go along with the next one, as what its first windows look back on.
    own = F.floor(index / size).cast("long")
    mine = F.when(F.pmod(index, F.lit(size)) >= size - max(spans), F.array(own, own + 1)).otherwise(F.array(own))

    def part(table: pa.Table) -> pa.Table:
        segment = table.column("_segment")[0].as_py()
        out = run(table.drop_columns("_segment"))
        return out.filter(pa.array(out.column("bar_index").to_numpy() // size == segment))

    return bars.withColumn("_segment", F.explode(mine)).groupBy("symbol", "_segment").applyInArrow(part, schema)


def affine(bars: DataFrame, src: Column, n: int, kind: str = "ema", out: str = "ema") -> DataFrame:
    """ema or rma as a fold over each symbol's array of values; no Python runs."""
    packed = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("bar_index", src.alias("x")))).alias("a"))
    k = 2.0 / (n + 1) if kind == "ema" else 1.0 / n
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("i"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        x = x["x"]
        if kind == "ema":
            v = F.when(s["i"] == 0, x).otherwise(x * k + s["v"] * (1 - k))
        else:
            v = F.when(s["i"] == 0, x).when(s["i"] < n, (s["v"] * s["i"] + x) / (s["i"] + 1)).otherwise((s["v"] * (n - 1) + x) / n)
        shown = F.when(s["i"] + 1 >= n, v)
        return F.struct(v.alias("v"), (s["i"] + 1).alias("i"), F.array_append(s["out"], shown).alias("out"))

    found = packed.select("symbol", "a", F.aggregate("a", start, step, lambda s: s["out"]).alias("o"))
    pairs = F.arrays_zip(F.transform("a", lambda x: x["bar_index"]).alias("bar_index"), F.col("o").alias("v"))
    return found.select("symbol", F.explode(pairs).alias("p")).select("symbol", F.col("p.bar_index"), F.col("p.v").alias(out))
