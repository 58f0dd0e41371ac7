"""The engine: sources and functions are registered, scripts compiled once and run for all symbols in parallel."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import in_seconds, to_text
from barloom.sources.bars import Catalog

from .builtins import text
from .columns import Sinks, compiled
from .interpreter import CROSS, Interpreter
from .syntax import Program, ScriptError, compile_script

MAGIC = "BARLOOM1\n"
_OF = (*CROSS, "value_of", "sma_of", "ema_of", "rsi_of")


def others_of(program: Program) -> list[tuple[str, str]]:
    """(symbol, value type) of every other series that a program names."""
    found: list[tuple[str, str]] = []

    def walk(e) -> None:
        if not isinstance(e, list):
            return
        if len(e) == 5 and e[0] == "call" and e[1][0] == "id" and e[1][1] in _OF:
            name, args = e[1][1], e[2]
            if not args or args[0][0] != "str":
                raise ScriptError(f"{name} needs the symbol as a literal")
            n = {"value_of": 1}.get(name, 2 if name.endswith("_of") and name not in CROSS else None)
            value = CROSS.get(name) or (args[n][1] if n is not None and len(args) > n and args[n][0] == "str" else "close")
            found.append((args[0][1], value))
        for x in e:
            walk(x)

    walk([program.body, [b for _, b in program.functions.values()], list(program.types.values())])
    return sorted(set(found))


class Result:
    """Per-bar values of a run, with its alerts and logs as tables.

    ``raw`` holds the rows of the interpreter's one pass for every sink; it is kept
    when first read, until ``close``. A compiled program has its frames instead.
    """

    def __init__(self, raw: DataFrame | None = None, sinks: Sinks | None = None):
        self.raw, self.sinks = raw if raw is None else raw.persist(), sinks

    def close(self) -> None:
        if self.raw is not None:
            self.raw.unpersist()

    @property
    def df(self) -> DataFrame:
        if self.sinks is not None:
            return self.sinks.values
        return self.raw.where("kind = 'value'").select("symbol", "bar_index", "value")

    def variables(self) -> DataFrame:
        """Final numeric root variables of each symbol."""
        if self.sinks is not None:
            return self.sinks.variables
        return self.raw.where("kind = 'variable'").select("symbol", F.col("message").alias("name"), "value")

    def alerts(self) -> DataFrame:
        if self.sinks is not None:
            return self.sinks.alerts.select("symbol", "bar_index", "time", "message", "freq")
        return self.raw.where("kind = 'alert'").select("symbol", "bar_index", F.col("value").alias("time"), "message", F.col("extra").alias("freq"))

    def logs(self) -> DataFrame:
        if self.sinks is not None:
            return self.sinks.logs.select("symbol", "bar_index", "time", "level", "message")
        return self.raw.where("kind = 'log'").select("symbol", "bar_index", F.col("value").alias("time"), F.col("extra").alias("level"), "message")

    def last(self) -> DataFrame:
        """The last bar's value of each symbol."""
        return self.df.groupBy("symbol").agg(F.max_by("value", "bar_index").alias("value"))

    def snapshot(self) -> DataFrame:
        """(symbol, bar_index, value, variables): the state after the last bar; variables of any kind, as text."""
        state = self.df.groupBy("symbol").agg(F.max("bar_index").alias("bar_index"), F.max_by("value", "bar_index").alias("value"))
        held = self.variables().select("symbol", "name", to_text(F.col("value")).alias("text"))
        if self.raw is not None:
            held = held.unionByName(self.raw.where("kind = 'text'").select("symbol", F.col("message").alias("name"), F.col("extra").alias("text")))
        held = held.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "text")))).alias("variables"))
        return state.join(held, "symbol", "left")


class Engine:
    def __init__(self, timeframe: str = "60", start: datetime | None = None, default_value_type: str = "close"):
        self.catalog = Catalog()
        self.functions: dict[str, tuple[Callable, list[str] | None]] = {}
        self.timeframe, self.start, self.default = timeframe, start, default_value_type

    def register_source(self, bars: DataFrame) -> Engine:
        if {"symbol", "bar_index"} - set(bars.columns):
            raise ValueError("bars need symbol and bar_index")
        self.catalog.add(bars)
        return self

    def register_function(self, name: str, f: Callable, params: list[str] | None = None) -> Engine:
        if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", name or ""):
            raise ValueError(f"invalid function name {name!r}")
        if params is not None:
            if len(set(params)) != len(params) or not all(re.fullmatch(r"[A-Za-z_]\w*", p or "") for p in params):
                raise ValueError("invalid parameter names")
            try:
                inspect.signature(f).bind(*params)
            except TypeError as e:
                raise ValueError(str(e)) from e
        self.functions[name] = (f, params)
        return self

    def symbols(self) -> list[str]:
        return [r.symbol for r in self.catalog.symbols().collect()]

    def value_types(self) -> list[str]:
        return self.catalog.value_types()

    def compile(self, text: str) -> str:
        """A program as text, independent of any source."""
        return MAGIC + compile_script(text).dumps()

    def execute(self, program: str, symbol: str | None = None, *, until: int | None = None) -> Result:
        """Runs a program for one symbol, or for all.

        Straight-line programs become columns; of others each symbol is one group of
        an Arrow pass. ``until`` replays up to that bar: later ones aren't seen.
        """
        if not program.startswith(MAGIC):
            raise ScriptError("not a compiled program")
        tree = Program.loads(program[len(MAGIC) :])
        bars = self.catalog.bars()
        if self.default not in bars.columns:
            raise ValueError(f"invalid default value type {self.default}")
        if until is not None:
            bars = bars.where(F.col("bar_index") <= until)
        prices = [c for c, t in bars.dtypes if c not in ("symbol", "bar_index", "bar_time") and t in ("double", "float", "int", "bigint")]
        bars = bars.select("symbol", "bar_index", *(F.col(c).cast("double").alias(c) for c in prices))
        needed = others_of(tree)
        run_on = bars if symbol is None else bars.where(F.col("symbol") == symbol)
        names = {}
        asked = sorted({other for other, _ in needed})
        if asked:
            known = {r.symbol for r in bars.where(F.col("symbol").isin(asked)).select("symbol").distinct().collect()}
            if missing := [a for a in asked if a not in known]:
                raise ScriptError(f"unknown symbol {missing[0]}")
        for i, (other, value) in enumerate(needed):
            column = value if value in prices else self.default
            side = bars.where(F.col("symbol") == other).select("bar_index", F.col(column).alias(f"_of{i}"))
            # A full join would keep the other symbol's longer tail, which only the *_of aggregates read.
            run_on = run_on.join(side, "bar_index", "left")
            names[f"_of{i}"] = (other, value)
        step = (in_seconds(self.timeframe) or 60) * 1000
        begin = self.start or datetime(1970, 1, 1, tzinfo=UTC)
        begin = begin.replace(tzinfo=begin.tzinfo or UTC).timestamp() * 1000
        sinks = compiled(tree, run_on, prices, {k: c for c, k in names.items()}, self.default, begin, step)
        if sinks is not None:
            return Result(sinks=sinks)
        functions, timeframe, start, default = self.functions, self.timeframe, self.start, self.default

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("bar_index")
            columns = {c: table.column(c).to_pylist() for c in prices}
            columns = {c: v for c, v in columns.items() if any(x is not None for x in v)}
            others = {k: table.column(c).to_pylist() for c, k in names.items()}
            symbol_, index = table.column("symbol")[0].as_py(), table.column("bar_index").to_pylist()
            engine = Interpreter(tree, columns, symbol=symbol_, others=others, functions=functions, timeframe=timeframe, start=start, default=default)
            values = engine.run()
            rows = [("value", i, v, None, None) for i, v in zip(index, values, strict=True)]
            rows += [("alert", a["bar_index"], a["time"], a["message"], a["freq"]) for a in engine.alerts]
            rows += [("log", a["bar_index"], a["time"], a["message"], a["level"]) for a in engine.logs]
            finals = {k: (1.0 if v else 0.0) if isinstance(v, bool) else v for k, v in engine.root.items() if v is None or isinstance(v, (int, float))}
            rows += [("variable", index[-1], None if v is None else float(v), k, None) for k, v in finals.items()]
            rows += [("text", index[-1], None, k, text(v)) for k, v in engine.root.items() if k not in finals]
            kinds, bars_, values_, messages, extra = zip(*rows, strict=True)
            return pa.table(
                {
                    "symbol": pa.array([symbol_] * len(rows)), "kind": pa.array(kinds), "bar_index": pa.array(bars_, pa.int64()),
                    "value": pa.array(values_, pa.float64()), "message": pa.array(messages, pa.string()), "extra": pa.array(extra, pa.string()),
                }
            )

        schema = "symbol string, kind string, bar_index long, value double, message string, extra string"
        return Result(run_on.groupBy("symbol").applyInArrow(run, schema))


default = Engine()
register_source, register_function, compile_, execute = default.register_source, default.register_function, default.compile, default.execute
__all__ = ["Engine", "Result", "ScriptError", "compile_", "compile_script", "default", "execute", "others_of", "register_function", "register_source"]
