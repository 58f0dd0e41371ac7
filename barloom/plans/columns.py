"""Straight-line scripts as DataFrame columns: Catalyst runs them, and no Python.

A program goes this way if each bar's values follow from prices by arithmetic,
windows of constant length, look-back and calls of its own functions. Loops,
branches, state (ema and its kind), containers and registered functions go to
the interpreter, whose results these columns equal: ``compiled`` returns None
for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import na
from barloom.functions import scalars as S
from barloom.operators import windows as T

from .interpreter import CONSTANTS, CROSS, NAMED
from .syntax import Program

PRICES = ("open", "high", "low", "close", "volume")
MIXED = {"hl2": "high low", "hlc3": "high low close", "hlcc4": "high low close close", "ohlc4": "open high low close"}


class Unsupported(Exception):
    """The program needs the interpreter."""


@dataclass
class Value:
    """A column with the kind that the script sees: num, bool, str, none or list (of values)."""

    kind: str
    column: Column | None = None
    constant: object = None
    items: list | None = None


def _num(c: Column) -> Value:
    return Value("num", c)


def _bool(c: Column) -> Value:
    return Value("bool", c)


@dataclass
class Sinks:
    """Frames of a compiled program."""

    values: DataFrame
    alerts: DataFrame
    logs: DataFrame
    variables: DataFrame


def _windows() -> dict[str, tuple[int, Callable, str]]:
    """name: (number of series, function of series and constants, kind of the result)."""
    C = F.col  # noqa: N806
    return {
        "sma": (1, T.sma, "num"), "wma": (1, T.wma, "num"), "swma": (1, T.swma, "num"), "linreg": (1, lambda x, n, o=0: T.linreg(x, n, o), "num"),
        "change": (1, T.change, "num"), "mom": (1, T.mom, "num"), "roc": (1, T.roc, "num"), "rsi": (1, T.rsi, "num"), "cmo": (1, T.cmo, "num"), "cci": (1, T.cci, "num"),
        "stdev": (1, lambda x, n, b=True: T.stdev(x, n, b), "num"), "variance": (1, lambda x, n, b=True: T.variance(x, n, b), "num"), "dev": (1, T.dev, "num"),
        "bb": (1, lambda x, n, m: T.bb(x, n, m), "list"), "bbw": (1, lambda x, n, m: T.bbw(x, n, m), "num"), "correlation": (2, T.correlation, "num"),
        "highest": (1, T.highest, "num"), "lowest": (1, T.lowest, "num"), "median": (1, T.median, "num"), "range": (1, T.range_, "num"),
        "rising": (1, T.rising, "bool"), "falling": (1, T.falling, "bool"), "stoch": (3, T.stoch, "num"),
        "crossover": (2, T.crossover, "bool"), "crossunder": (2, T.crossunder, "bool"), "cross": (2, T.cross, "bool"),
        "tr": (0, lambda *_: T.tr(C("high"), C("low"), C("close")), "num"), "wpr": (0, lambda n: T.wpr(C("high"), C("low"), C("close"), n), "num"),
        "vwma": (1, lambda x, n: T.vwma(x, C("volume"), n), "num"),
    }


def _math() -> dict[str, Callable]:
    return {
        "abs": F.abs, "max": na.vmax, "min": na.vmin, "round": S.round_, "floor": S.floor_, "ceil": S.ceil_, "pow": S.pow_, "sqrt": S.sqrt_,
        "avg": S.avg_, "sum": S.sum_, "exp": S.exp_, "sin": S.sin_, "cos": S.cos_, "tan": S.tan_, "acos": S.acos_, "asin": S.asin_, "atan": S.atan_,
        "sign": S.sign_, "todegrees": S.todegrees, "toradians": S.toradians,
    }


class Compiler:
    """``of``: the column of another symbol's series; ``columns``: prices at hand."""

    def __init__(self, program: Program, columns: list[str], of: dict[tuple[str, str], Column], default: str, symbol: Column, start_ms: float, step_ms: float):
        self.p, self.columns, self.of, self.default = program, columns, of, default
        self.symbol, self.start, self.step = symbol, start_ms, step_ms
        self.windows, self.math = _windows(), _math()
        self.none = Value("none", F.lit(None).cast("double"))
        self.root: dict[str, Value] = {}
        self.scopes = [self.root]
        self.lazy = self.depth = 0
        self.last: Column | None = None
        self.alerts: list[tuple[Column, Column, Column]] = []
        self.logs: list[tuple[str, Column]] = []
        self.times = {}
        for s in program.body:
            for name in [s[1]] if s and s[0] in ("decl", "assign") else s[1] if s and s[0] == "tuple" else []:
                self.times[name] = self.times.get(name, 0) + 1

    # --- statements ---

    def run(self) -> None:
        for s in self.p.body:
            if s is None:
                continue
            value = self.statement(s)
            if s[0] in ("expr", "decl", "assign"):
                if value.kind in ("num", "bool"):
                    self.last = value.column.cast("double")
                elif value.kind == "none":
                    self.last = F.lit(None).cast("double")

    def statement(self, s: list) -> Value:
        kind = s[0]
        if kind == "expr":
            return self.eval(s[1])
        if kind == "decl":
            value = self.eval(s[2])
            if s[4] == "bool" and value.kind != "bool" or s[3]:
                raise Unsupported(s[1])
            return self.bind(s[1], value)
        if kind == "assign":
            value = self.eval(s[3])
            if s[2] not in ("=", ":="):
                value = self.binary(s[2][0], self.name(s[1]), value)
            return self.bind(s[1], value)
        if kind == "tuple":
            value = self.eval(s[2])
            if value.kind != "list":
                raise Unsupported("tuple")
            for name, v in zip(s[1], [*value.items, *[self.none] * len(s[1])], strict=False):
                if name != "_":
                    self.bind(name, v)
            return value
        raise Unsupported(kind)

    def bind(self, name: str, value: Value) -> Value:
        if "." in name or len(self.scopes) > 1 and name in self.root and name not in self.scopes[-1]:
            raise Unsupported(name)
        self.scopes[-1][name] = value
        return value

    # --- expressions ---

    def price(self, name: str) -> Column:
        has = lambda n: F.col(n if n in self.columns else self.default)
        if name in MIXED and name not in self.columns:
            xs = [has(n) for n in MIXED[name].split()]
            return S.sum_(*xs) / len(xs)
        return has(name)

    def special(self, name: str) -> Value | None:
        i = F.col("bar_index").cast("double")
        if name in PRICES or name in MIXED or name in self.columns:
            return _num(self.price(name))
        if name in CONSTANTS:
            v = CONSTANTS[name]
            return Value("str" if isinstance(v, str) else "num", F.lit(v), v)
        if name in ("last_bar_index", "barstate.islast"):
            last = F.max("bar_index").over(Window.partitionBy("symbol")).cast("double")
            return _num(last) if name == "last_bar_index" else _bool(i == last)
        return {
            "bar_index": _num(i), "barstate.isfirst": _bool(i == 0), "syminfo.ticker": Value("str", self.symbol),
            "time": _num(F.lit(self.start) + i * self.step), "time_close": _num(F.lit(self.start) + (i + 1) * self.step),
        }.get(name)

    def name(self, name: str) -> Value:
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        found = self.special(name)
        if found is None:
            raise Unsupported(name)
        return found

    def eval(self, e: list) -> Value:
        kind = e[0]
        if kind == "num":
            return Value("num", F.lit(float(e[1])), float(e[1]))
        if kind == "str":
            return Value("str", F.lit(e[1]), e[1])
        if kind == "bool":
            return Value("bool", F.lit(e[1]), e[1])
        if kind == "na":
            return self.none
        if kind == "id":
            return self.name(e[1])
        if kind == "bin":
            return self.binary(e[1], self.eval(e[2]), self.eval(e[3]))
        if kind == "un":
            v = self.eval(e[2])
            if e[1] == "not":
                return _bool(~self.truth(v))
            n = self.number(v)
            constant = v.constant if v.kind == "num" else None
            if e[1] != "-":
                return Value("num", n, constant)
            return Value("num", -n, -constant if constant is not None else None)
        if kind == "tern":
            cond = self.truth(self.eval(e[1]))
            self.lazy += 1
            a, b = self.eval(e[2]), self.eval(e[3])
            self.lazy -= 1
            kinds = {a.kind, b.kind} - {"none"}
            if len(kinds) > 1 or "list" in kinds:
                raise Unsupported("ternary")
            kind = kinds.pop() if kinds else "none"
            to = {"bool": "boolean", "str": "string"}.get(kind, "double")
            return Value(kind, F.when(cond, a.column.cast(to)).otherwise(b.column.cast(to)))
        if kind == "index":
            return self.index(e)
        if kind == "call":
            return self.call(e)
        raise Unsupported(kind)

    def number(self, v: Value) -> Column:
        if v.kind in ("num", "bool"):
            return v.column.cast("double")
        if v.kind == "list":
            raise Unsupported("list")
        return F.lit(None).cast("double")

    def truth(self, v: Value) -> Column:
        if v.kind == "list":
            raise Unsupported("list")
        if v.kind == "str":
            return F.coalesce(v.column != "", F.lit(False))
        return F.coalesce(v.column if v.kind == "bool" else v.column != 0, F.lit(False))

    def text(self, v: Value) -> Column:
        if v.kind == "str":
            return F.coalesce(v.column, F.lit("na"))
        if v.kind == "bool":
            return F.coalesce(v.column.cast("string"), F.lit("na"))
        if v.kind == "list":
            raise Unsupported("list")
        return S.to_text(v.column)

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("and", "or"):
            x, y = self.truth(a), self.truth(b)
            return _bool(x & y if op == "and" else x | y)
        if op in ("==", "!="):
            if "none" in (a.kind, b.kind):
                same = F.lit(False)
            elif a.kind == "str" and b.kind == "str":
                same = F.coalesce(a.column == b.column, F.lit(False))
            elif "str" in (a.kind, b.kind):
                raise Unsupported("equality of text and number")
            else:
                same = na.eq(self.number(a), self.number(b))
            return _bool(same if op == "==" else ~same)
        if op == "+" and "str" in (a.kind, b.kind):
            return Value("str", F.concat(self.text(a), self.text(b)))
        x, y = self.number(a), self.number(b)
        if op in ("<", "<=", ">", ">="):
            test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return _bool(F.coalesce(test, F.lit(False)))
        if op in ("+", "-", "*"):
            return _num(x + y if op == "+" else x - y if op == "-" else x * y)
        ratio = na.div(x, y)
        if op == "/":
            return _num(ratio)
        return _num(x - y * F.when(ratio >= 0, F.floor(ratio)).otherwise(F.ceil(ratio)))

    def lag(self, v: Value, k: int) -> Value:
        if v.kind not in ("num", "bool", "str", "none"):
            raise Unsupported("look-back")
        return Value(v.kind, T.lag(v.column, k))

    def index(self, e: list) -> Value:
        k = self.eval(e[2]).constant
        if not isinstance(k, float) or k < 0:
            raise Unsupported("look-back by a computed number")
        k, target = int(k), e[1]
        if target[0] == "id":
            name = target[1]
            local = next((s for s in reversed(self.scopes[1:]) if name in s), None)
            if local is None and name in self.root:
                # The value at the end of earlier bars: known if nothing assigns the name again.
                if self.times.get(name) != 1:
                    raise Unsupported(name)
                v = self.lag(self.root[name], k)
                return _bool(F.coalesce(v.column, F.lit(False))) if v.kind == "bool" and k else v
            if local is None:
                v = self.special(name)
                if v is None or v.kind == "str" or name in ("time", "time_close", "bar_index"):
                    raise Unsupported(name)
                return self.lag(v, k)
        elif target[0] == "arr":
            raise Unsupported("array")
        if self.lazy:
            raise Unsupported("a branch remembers only its own bars")
        return self.lag(self.eval(target), k)

    # --- calls ---

    def arguments(self, name: str, params: list[str] | None, e: list) -> list[Value]:
        args, named = [self.eval(a) for a in e[2]], {k: self.eval(v) for k, v in e[3]}
        if not named:
            return args
        if params is None or set(named) - set(params[len(args) :]):
            raise Unsupported(name)
        rest = params[len(args) :]
        while rest and rest[-1] not in named:
            rest = rest[:-1]
        if any(p not in named for p in rest):
            raise Unsupported(name)
        return [*args, *(named[p] for p in rest)]

    def call(self, e: list) -> Value:
        if e[1][0] != "id":
            raise Unsupported("method")
        name = e[1][1]
        if name in self.p.functions:
            return self.function(name, e)
        bare = name[3:] if name.startswith("ta.") else name
        if bare in self.windows and (name.startswith("ta.") or bare not in ("median", "range", "variance", "dev", "rising", "falling")):
            if self.lazy:
                raise Unsupported("a branch remembers only its own bars")
            count, f, kind = self.windows[bare]
            args = self.arguments(name, NAMED.get(f"ta.{bare}"), e)
            if len(args) < count or any(a.constant is None for a in args[count:]):
                raise Unsupported(name)
            constants = [a.constant if isinstance(a.constant, bool) or not float(a.constant).is_integer() else int(a.constant) for a in args[count:]]
            if bare in ("bb", "bbw") and len(constants) == 2:
                constants[1] = float(constants[1])
            if constants and not isinstance(constants[0], bool) and constants[0] <= 0 or any(c not in self.columns for c in self.reads(bare)):
                raise Unsupported(name)
            try:
                out = f(*(self.number(a) for a in args[:count]), *constants)
            except TypeError as err:
                raise Unsupported(name) from err
            return Value("list", items=[_num(c) for c in out]) if kind == "list" else Value(kind, out)
        if name in CROSS or name == "value_of":
            args = [self.eval(a) for a in e[2]]
            value = CROSS.get(name) or (args[1].constant if len(args) > 1 else None)
            if not args or e[3] or (args[0].constant, value) not in self.of:
                raise Unsupported(name)
            return _num(self.of[args[0].constant, value])
        if bare == name and name == "na" or name == "nz":
            args = self.arguments(name, NAMED.get(name), e)
            if not args or args[0].kind not in ("num", "none"):
                raise Unsupported(name)
            if name == "na":
                return _bool(args[0].column.isNull())
            return _num(F.coalesce(args[0].column, self.number(args[1]) if len(args) > 1 else F.lit(0.0)))
        simple = name[5:] if name.startswith("math.") else name
        if simple in self.math and not e[3] and (name.startswith("math.") or simple not in self.windows):
            args = [self.number(self.eval(a)) for a in e[2]]
            if not args:
                raise Unsupported(name)
            out = self.math[simple](*args)
            return _num(F.when(na.every(*args), out.cast("double")))
        if name in ("alertcondition", "alert") and not self.depth and not self.lazy:
            return self.alert(name, self.arguments(name, NAMED[name], e))
        if name in ("log.info", "log.warning", "log.error") and not self.depth and not self.lazy and not e[3]:
            return self.log(name[4:], [self.eval(a) for a in e[2]])
        raise Unsupported(name)

    @staticmethod
    def reads(bare: str) -> tuple[str, ...]:
        return {"tr": ("high", "low", "close"), "wpr": ("high", "low", "close"), "vwma": ("volume",)}.get(bare, ())

    def function(self, name: str, e: list) -> Value:
        params, body = self.p.functions[name]
        args = self.arguments(name, [p for p, _ in params], e)
        if len(args) > len(params) or self.depth > 20:
            raise Unsupported(name)
        scope = {}
        for i, (p, d) in enumerate(params):
            scope[p] = args[i] if i < len(args) else self.eval(d) if d is not None else self.none
        self.scopes.append(scope)
        self.depth += 1
        try:
            value = self.none
            for s in body:
                if s is not None:
                    value = self.statement(s)
                    if s[0] == "tuple":
                        value = self.none
            return value
        finally:
            self.scopes.pop()
            self.depth -= 1

    def alert(self, name: str, args: list[Value]) -> Value:
        if not args:
            raise Unsupported(name)
        blank = Value("str", F.lit(""), "")
        if name == "alert":
            self.alerts.append((F.lit(True), self.text(args[0]), self.text(args[1] if len(args) > 1 else blank)))
        else:
            message = args[2] if len(args) > 2 else args[1] if len(args) > 1 else blank
            self.alerts.append((self.truth(args[0]), self.text(message), F.lit("")))
        return self.none

    def log(self, level: str, args: list[Value]) -> Value:
        template = args[0].constant if args else ""
        if not isinstance(template, str) or re.search(r"\{\s*\d+\s*,", template):
            raise Unsupported("log pattern")
        given = [S.text_arg(self.text(a)) for a in args[1:]]
        self.logs.append((level, S.format_(template, *given)))
        return self.none


def compiled(
    program: Program, bars: DataFrame, columns: list[str], of: dict[tuple[str, str], str], default: str, start_ms: float, step_ms: float
) -> Sinks | None:
    """The sinks of a straight-line program over ``bars``, or None."""
    compiler = Compiler(program, columns, {k: F.col(c) for k, c in of.items()}, default, F.col("symbol"), start_ms, step_ms)
    try:
        compiler.run()
    except Unsupported:
        return None
    # A series that a symbol lacks altogether is read from the default one.
    whole = Window.partitionBy("symbol")
    nullable = {f.name for f in bars.schema.fields if f.nullable}
    used = [c for c in columns if c != default and c in nullable]
    bars = bars.withColumns({c: F.when(F.max(c).over(whole).isNull(), F.col(default)).otherwise(F.col(c)) for c in used})
    value = compiler.last if compiler.last is not None else F.lit(None).cast("double")
    time = F.lit(start_ms) + F.col("bar_index").cast("double") * step_ms
    values = bars.select("symbol", "bar_index", value.alias("value"))
    rows = [F.struct((time + step_ms).alias("time"), ok.alias("ok"), m.alias("message"), f.alias("freq")) for ok, m, f in compiler.alerts]
    alerts = _rows(bars, rows, "time double, ok boolean, message string, freq string").where("ok").drop("ok")
    rows = [F.struct(time.alias("time"), F.lit(level).alias("level"), m.alias("message")) for level, m in compiler.logs]
    logs = _rows(bars, rows, "time double, level string, message string")
    finals = {k: v.column.cast("double") for k, v in compiler.root.items() if v.kind in ("num", "bool", "none")}
    rows = [F.struct(F.lit(k).alias("name"), c.alias("value")) for k, c in finals.items()]
    last = F.max("bar_index").over(whole)
    variables = _rows(bars.withColumn("_last", last), rows, "name string, value double", "_last").where("bar_index = _last")
    return Sinks(values, alerts, logs, variables.select("symbol", "name", "value"))


def _rows(bars: DataFrame, structs: list[Column], schema: str, *more: str) -> DataFrame:
    """One row of a bar for each struct, in their order."""
    kind = f"array<struct<{', '.join(':'.join(f.strip().rsplit(' ', 1)) for f in schema.split(','))}>>"
    made = F.array(*structs).cast(kind)
    out = bars.select("symbol", "bar_index", *more, made.alias("_rows"))
    return out.select("symbol", "bar_index", *more, F.explode("_rows").alias("_row")).select("symbol", "bar_index", *more, "_row.*")
