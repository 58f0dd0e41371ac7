"""Incremental indicators under Structured Streaming.

The machines of ``operators.kernels`` are the state: each symbol's machine is
pickled into the stream's state store, so a micro-batch only sees its new bars.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.scans import Scan


def stream_bars(events: DataFrame, symbol: str = "event_type", time: str = "ts", value: str = "value", period: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of an event stream; a bar is emitted when the watermark passes its end, later events are dropped."""
    at = F.col(time).cast("timestamp")
    v = F.col(value).cast("double")
    rows = events.select(F.col(symbol).alias("symbol"), at.alias("ts"), v.alias("v")).withWatermark("ts", late)
    bars = rows.groupBy("symbol", F.window("ts", period).alias("w")).agg(
        F.min_by("v", "ts").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("bar_time"), "open", "high", "low", "close", "volume")


def stream_scan(bars: DataFrame, *scans: Scan, order: str = "bar_time") -> DataFrame:
    """Streaming bars with the outputs of scans, one row a bar, in order within a symbol and micro-batch.

    Bars of a symbol must arrive in order of ``order`` between micro-batches,
    as ``stream_bars`` in append mode gives them.
    """
    new = [o for s in scans for o in s.outputs]
    kept = [f for f in bars.schema.fields if f.name not in new]
    out = T.StructType([*kept, *(T.StructField(o, T.DoubleType()) for o in new)])
    names = [f.name for f in kept]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # Machines made by closures can't be pickled, so the state keeps the machines' fields.
        machines = [s.make() for s in scans]
        if state.exists:
            for m, held in zip(machines, pickle.loads(state.get[0]), strict=True):
                _restore(m, held)
        rows = pd.concat(list(batches)).sort_values(order)
        columns: dict[str, list] = {o: [] for o in new}
        for row in rows.itertuples(index=False):
            for s, m in zip(scans, machines, strict=True):
                values = m(*(None if pd.isna(getattr(row, i)) else getattr(row, i) for i in s.inputs))
                for o, v in zip(s.outputs, (values,) if len(s.outputs) == 1 else values, strict=True):
                    columns[o].append(v)
        state.update((pickle.dumps([_fields(m) for m in machines]),))
        made = rows[names].reset_index(drop=True)
        for o, v in columns.items():
            made[o] = pd.Series(v, dtype="float64")
        yield made

    return bars.groupBy("symbol").applyInPandasWithState(step, out, "machines binary", "append", "NoTimeout")


def _fields(machine: object) -> object:
    """A machine's state without its code: nested machines become dictionaries."""
    if hasattr(machine, "__dict__") and type(machine).__module__.startswith("barloom."):
        return {k: _fields(v) for k, v in vars(machine).items() if not callable(v) or hasattr(v, "__dict__") and type(v).__module__.startswith("barloom.")}
    if isinstance(machine, tuple):
        return tuple(_fields(x) for x in machine)
    return machine


def _restore(machine: object, held: object) -> None:
    for k, v in held.items():
        old = getattr(machine, k)
        if isinstance(v, dict) and hasattr(old, "__dict__"):
            _restore(old, v)
        elif isinstance(v, tuple) and isinstance(old, tuple) and any(isinstance(x, dict) for x in v):
            for o, x in zip(old, v, strict=True):
                _restore(o, x)
        else:
            setattr(machine, k, v)


def replay(bars: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None] | None = None):
    """Runs ``build`` over the Parquet files under ``path`` as a stream until they are used up; each batch goes to ``sink``."""
    stream = bars.sparkSession.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)
    writer = build(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(sink or (lambda df, _: df.count())).start()
