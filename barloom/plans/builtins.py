"""Built-in functions of scripts over plain values; na is None.

``PURE`` functions see argument values only. ``STATEFUL`` ones are made once for
each call site from their constant arguments and then see each bar's values.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from barloom.functions import linalg
from barloom.functions.scalars import from_seconds, in_seconds, timestamp
from barloom.operators import kernels as K

from .syntax import ScriptError


def text(v) -> str:
    """A value as text: the shortest digits, with an exponent from 1e6 on and under 1e-4."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return "na"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        if math.isinf(v):
            return "+Inf" if v > 0 else "-Inf"
        shortest = np.format_float_scientific(float(v), trim="-")
        p = int(shortest.partition("e")[2])
        digits = shortest.partition("e")[0].lstrip("-").replace(".", "")
        if v and (p < -4 or p >= 6):
            lead = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
            return f"{'-' if v < 0 else ''}{lead}e{'-' if p < 0 else '+'}{abs(p):02d}"
        return np.format_float_positional(float(v), trim="-")
    if isinstance(v, list):
        return "[" + " ".join(map(text, v)) + "]"
    return str(v)


def number(v) -> float | None:
    if isinstance(v, bool):
        return 1.0 if v else 0.0
    return float(v) if isinstance(v, (int, float)) and not (isinstance(v, float) and math.isnan(v)) else None


def truth(v) -> bool:
    return v is not None and v != 0 and v != "" and not (isinstance(v, float) and math.isnan(v))


def equal(a, b) -> bool:
    if a is None or b is None:
        return False
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b)
    return text(a) == text(b)


def num(f):
    """A function of numbers that is na if an argument is na or the result isn't a number."""

    def run(*args):
        xs = [number(a) for a in args]
        if any(x is None for x in xs):
            return None
        try:
            out = f(*xs)
        except (ValueError, ZeroDivisionError, OverflowError):
            return None
        return None if isinstance(out, float) and math.isnan(out) else out

    return run


def no_bool(f, name):
    def run(v, *rest):
        if isinstance(v, bool):
            raise ScriptError(f"{name} doesn't take a bool")
        return f(v, *rest)

    return run


def at(a: list, i) -> int:
    i = int(i)
    if not 0 <= i < len(a):
        raise ScriptError(f"index {i} is out of range")
    return i


def need(a: list) -> list:
    if not a:
        raise ScriptError("array is empty")
    return a


def pattern(v: float, spec: str) -> str | None:
    spec = spec.replace(",", "")
    whole, _, part = spec.partition(".")
    if set(whole + part) - {"#", "0"}:
        return None
    out = f"{v:.{len(part)}f}"
    sign, out = ("-", out[1:]) if out[0] == "-" else ("", out)
    a, _, b = out.partition(".")
    while len(b) > part.count("0") and b.endswith("0"):
        b = b[:-1]
    return sign + a.rjust(max(whole.count("0"), 1), "0") + ("." + b if b else "")


def fill(template: str, *args) -> str:
    import re

    def one(m):
        if m.group(0) in ("{{", "}}"):
            return m.group(0)[0]
        i = int(m.group(1))
        if i >= len(args):
            return m.group(0)
        parts = (m.group(2) or "").split(",")
        v = number(args[i])
        if len(parts) >= 3 and parts[1].strip().lower() == "number" and v is not None and not isinstance(args[i], str):
            done = pattern(v, ",".join(parts[2:]).strip())
            if done is not None:
                return done
        return text(args[i])

    return re.sub(r"\{\{|\}\}|\{\s*(\d+)\s*(,[^{}]*)?\}", one, template)


class Matrix:
    def __init__(self, rows):
        self.a = np.array(rows, float) if not isinstance(rows, np.ndarray) else rows


def key(k):
    return float(k) if isinstance(k, (int, float)) and not isinstance(k, bool) else k


def _sorted_keys(m: dict) -> list:
    return sorted(m, key=lambda k: f"{'float64' if isinstance(k, float) else type(k).__name__}:{text(k)}")


def nums(a):
    return [float(x) for x in a]


def _stat(f):
    return lambda a: f(nums(a)) if a else None


def _nth(high):
    def run(a, n=0):
        s = sorted(nums(a), reverse=high)
        return s[int(n)] if 0 <= int(n) < len(s) else None

    return run


def _mode(v):
    c = Counter(float(f"{x:.15g}") for x in v)
    return min(c, key=lambda x: (-c[x], x))


def _find(a, v, back=False):
    for i in reversed(range(len(a))) if back else range(len(a)):
        if equal(a[i], v):
            return float(i)
    return -1.0


def _set(a, i, v):
    a[at(a, i)] = v
    return a


def _do(f):
    """A mutation that returns the container."""

    def run(a, *rest):
        f(a, *rest)
        return a

    return run


def _insert(a, i, v):
    if not 0 <= int(i) <= len(a):
        raise ScriptError(f"index {int(i)} is out of range")
    a.insert(int(i), v)
    return a


def _covariance(a, b, biased=True):
    n = len(a) - (0 if biased else 1)
    if len(a) != len(b) or n <= 0:
        return None
    ma, mb = K.mean(a), K.mean(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / n


def _rank(a, i):
    return 100 * (sum(x <= a[at(a, i)] for x in a) - 1) / (len(a) - 1) if len(a) > 1 else None


def _cut(seq, start, end=None):
    start, end = max(0, int(start)), len(seq) if end is None else min(len(seq), int(end))
    return seq[start:max(start, end)]


UNARY_MATH = {
    "abs": abs, "floor": lambda x: float(math.floor(x)), "ceil": lambda x: float(math.ceil(x)), "sqrt": math.sqrt,
    "exp": math.exp, "sin": math.sin, "cos": math.cos, "tan": math.tan, "acos": math.acos, "asin": math.asin, "atan": math.atan,
    "log10": lambda x: -math.inf if x == 0 else math.log10(x), "sign": lambda x: float((x > 0) - (x < 0)),
    "todegrees": math.degrees, "toradians": math.radians, "round": lambda x: math.copysign(math.floor(abs(x) + 0.5), x),
}
PURE: dict = {}
for _n, _f in UNARY_MATH.items():
    PURE[_n] = PURE[f"math.{_n}"] = num(_f)
for _n, _f in {
    "max": lambda *a: max(a), "min": lambda *a: min(a), "pow": lambda a, b: math.pow(a, b),
    "avg": lambda *a: sum(a) / len(a), "sum": lambda *a: float(sum(a)),
}.items():
    PURE[_n] = PURE[f"math.{_n}"] = num(_f)
PURE["math.log"] = num(lambda x: -math.inf if x == 0 else math.log(x))


def _random(a=1.0, b=None, *_):
    lo, hi = (0.0, a) if b is None else (min(a, b), max(a, b))
    return random.uniform(lo, hi)


PURE |= {
    "math.random": _random,
    "int": lambda x: None if number(x) is None else int(number(x)),
    "float": number, "bool": truth, "string": lambda x="", *_: text(x), "str.tostring": lambda x, *_: text(x),
    "indicator": lambda *a: None, "na": no_bool(lambda v: v is None, "na"), "nz": no_bool(lambda v, r=0.0: r if v is None else v, "nz"),
    "fixnan": no_bool(lambda v: v, "fixnan"),
    "color": lambda r, g, b: {"r": r, "g": g, "b": b}, "color.rgb": lambda r, g, b: {"r": r, "g": g, "b": b},
    "color.new": lambda base, transp=0.0: {"base": base, "transp": transp},
    "box.new": lambda left, top, right, bottom, *_: {"type": "box", "left": left, "top": top, "right": right, "bottom": bottom},
    "box.get_top": lambda b: b.get("top") if isinstance(b, dict) else None, "box.get_bottom": lambda b: b.get("bottom") if isinstance(b, dict) else None,
    "box.set_right": lambda b, x: b.update(right=x), "box.delete": lambda *a: None,
    "table.new": lambda *a: {"type": "table"}, "table.cell": lambda *a: None, "linefill.new": lambda *a: {"type": "linefill"},
    "barcolor": lambda *a: None, "line.new": lambda *a: {"type": "line"}, "label.new": lambda *a: {"type": "label"},
    "line.set_xy1": lambda o, x, y: o.update(x1=x, y1=y), "line.set_xy2": lambda o, x, y: o.update(x2=x, y2=y),
    "line.set_color": lambda o, c: o.update(color=c), "label.set_xy": lambda o, x, y: o.update(x=x, y=y),
    "label.set_text": lambda o, s: o.update(text=s), "label.set_tooltip": lambda o, s: o.update(tooltip=s),
    # maps
    "map.new": lambda *a: {}, "map.clear": _do(dict.clear), "map.copy": dict, "map.size": lambda m: float(len(m)),
    "map.put": _do(lambda m, k, v: m.__setitem__(key(k), v)), "map.get": lambda m, k: m.get(key(k)), "map.contains": lambda m, k: key(k) in m,
    "map.remove": _do(lambda m, k: m.pop(key(k), None)), "map.keys": _sorted_keys, "map.values": lambda m: [m[k] for k in _sorted_keys(m)],
    # arrays
    "array.size": lambda a: float(len(a)), "array.get": lambda a, i: a[at(a, i)], "array.set": _set, "array.push": _do(list.append),
    "array.pop": lambda a: need(a).pop(), "array.unshift": _do(lambda a, v: a.insert(0, v)), "array.shift": lambda a: need(a).pop(0),
    "array.clear": _do(list.clear), "array.remove": lambda a, i: a.pop(at(a, i)), "array.concat": lambda a, b: a + b,
    "array.slice": _cut, "array.includes": lambda a, v: _find(a, v) >= 0, "array.indexof": _find, "array.lastindexof": lambda a, v: _find(a, v, True),
    "array.copy": list, "array.from": lambda *v: list(v), "array.insert": _insert, "array.first": lambda a: need(a)[0], "array.last": lambda a: need(a)[-1],
    "array.join": lambda a, sep="": sep.join(map(text, a)), "array.every": lambda a, *v: all(equal(x, v[0]) if v else truth(x) for x in a),
    "array.abs": lambda a: [abs(x) for x in nums(a)], "array.sum": lambda a: float(sum(nums(a))), "array.avg": _stat(K.mean),
    "array.max": _nth(True), "array.min": _nth(False), "array.range": _stat(lambda v: max(v) - min(v)), "array.median": _stat(lambda v: K.pct_linear(v, 50)),
    "array.mode": _stat(_mode), "array.percentrank": _rank,
    "array.percentile_linear_interpolation": lambda a, p: K.pct_linear(nums(a), p) if a else None,
    "array.percentile_nearest_rank": lambda a, p: K.pct_nearest(nums(a), p) if a else None,
    "array.binary_search_leftmost": _find, "array.binary_search_rightmost": lambda a, v: _find(a, v, True), "array.covariance": _covariance,
    # strings
    "str.length": lambda s: float(len(s)), "str.upper": str.upper, "str.lower": str.lower, "str.contains": lambda s, x: x in s,
    "str.startswith": str.startswith, "str.endswith": str.endswith, "str.replace": lambda s, a, b, *_: s.replace(a, b), "str.substring": _cut,
    "str.split": lambda s, sep: s.split(sep) if sep else list(s), "str.format": fill,
    "timeframe.in_seconds": lambda tf=None: in_seconds(tf), "timeframe.from_seconds": from_seconds, "timestamp": timestamp,
}
PURE["array.percentile_neareast_rank"] = PURE["array.percentile_nearest_rank"]
for _t in ("int", "float", "bool", "string", "box"):
    PURE[f"array.new_{_t}"] = lambda n=0, init=None: [init] * int(n)
#: What an input without a default gives.
for _t, _v in {"": None, ".int": 0.0, ".float": 0.0, ".bool": False, ".string": "", ".color": "", ".time": 0.0, ".session": "", ".symbol": "", ".source": None}.items():
    PURE[f"input{_t}"] = lambda defval=None, *_, _v=_v: _v if defval is None else defval


# --- matrices ---


def _m(f):
    """A function of arrays; array results become matrices."""

    def run(*args):
        try:
            out = f(*(x.a if isinstance(x, Matrix) else x for x in args))
        except (ValueError, IndexError, np.linalg.LinAlgError) as e:
            raise ScriptError(str(e)) from e
        return Matrix(out) if isinstance(out, np.ndarray) and out.ndim == 2 else out.tolist() if isinstance(out, np.ndarray) else out

    return run


def _mset(f):
    """A function that changes a matrix in place and returns it."""

    def run(m, *args):
        try:
            m.a = f(m.a, *args)
        except (ValueError, IndexError) as e:
            raise ScriptError(str(e)) from e
        return m

    return run


def _ij(a, *index):
    for i, n in zip(index, a.shape, strict=False):
        if not 0 <= int(i) < n:
            raise ScriptError("matrix index out of range")
    return tuple(map(int, index))


def _mput(a, r, c, v):
    a = a.copy()
    a[_ij(a, r, c)] = v
    return a


def _mfill(a, v, r0=0, r1=None, c0=0, c1=None):
    a = a.copy()
    a[int(r0) : None if r1 is None else int(r1), int(c0) : None if c1 is None else int(c1)] = v
    return a


def _swapped(a, i, j, axis):
    order = list(range(a.shape[axis]))
    order[int(i)], order[int(j)] = order[int(j)], order[int(i)]
    return np.take(a, order, axis)


def _mconcat(a, b):
    if a.shape[0] == b.shape[0]:
        return np.hstack([a, b])
    return np.vstack([a, b])


def _is(kind):
    def run(m):
        a = m.a
        n, square = len(a), a.ndim == 2 and a.shape[0] == a.shape[1]
        zero = lambda x: bool((np.abs(x) <= 1e-9).all())
        if kind in ("zero", "binary"):
            return zero(a) if kind == "zero" else zero(np.minimum(np.abs(a), np.abs(a - 1)))
        if not square or kind == "square":
            return square
        return {
            "symmetric": lambda: zero(a - a.T), "antisymmetric": lambda: zero(a + a.T), "diagonal": lambda: zero(a - np.diag(np.diag(a))),
            "identity": lambda: zero(a - np.eye(n)), "triangular": lambda: zero(np.tril(a, -1)) or zero(np.triu(a, 1)),
            "antidiagonal": lambda: zero(np.fliplr(a) - np.diag(np.diag(np.fliplr(a)))),
            "stochastic": lambda: bool((a >= -1e-9).all() and (np.abs(a.sum(axis=1) - 1) <= 1e-6).all()),
        }[kind]()

    return run


PURE |= {
    "matrix.copy": lambda m: Matrix(m.a.copy()), "matrix.get": lambda m, r, c: float(m.a[_ij(m.a, r, c)]), "matrix.set": _mset(_mput),
    "matrix.row": lambda m, r: m.a[_ij(m.a, r)[0]].tolist(), "matrix.col": lambda m, c: m.a[:, _ij(m.a.T, c)[0]].tolist(),
    "matrix.rows": lambda m: float(m.a.shape[0]), "matrix.columns": lambda m: float(m.a.shape[1]) if len(m.a) else 0.0,
    "matrix.elements_count": lambda m: float(m.a.size), "matrix.fill": _mset(_mfill), "matrix.reshape": _mset(lambda a, r, c: a.reshape(int(r), int(c)).copy()),
    "matrix.submatrix": _m(lambda a, r0, r1, c0, c1: a[int(r0) : int(r1), int(c0) : int(c1)].copy()),
    "matrix.add_row": _mset(lambda a, *x: np.insert(a, int(x[0]) if len(x) > 1 else len(a), x[-1], axis=0)),
    "matrix.add_col": _mset(lambda a, *x: np.insert(a, int(x[0]) if len(x) > 1 else a.shape[1], x[-1], axis=1)),
    "matrix.remove_row": _mset(lambda a, i: np.delete(a, _ij(a, i)[0], axis=0)), "matrix.remove_col": _mset(lambda a, i: np.delete(a, _ij(a.T, i)[0], axis=1)),
    "matrix.swap_rows": _mset(lambda a, i, j: _swapped(a, i, j, 0)), "matrix.swap_columns": _mset(lambda a, i, j: _swapped(a, i, j, 1)),
    "matrix.reverse": _mset(lambda a: a[::-1, ::-1].copy()), "matrix.sort": _mset(lambda a, *_: np.sort(a, axis=None).reshape(a.shape)),
    "matrix.concat": _m(_mconcat), "matrix.diff": _m(lambda a, b: a - b), "matrix.kron": _m(np.kron), "matrix.mult": _m(lambda a, b: a @ b),
    "matrix.pow": _m(linalg.power), "matrix.transpose": _m(lambda a: a.T.copy()), "matrix.det": _m(linalg.det), "matrix.rank": _m(linalg.rank),
    "matrix.trace": _m(lambda a: float(np.trace(a))), "matrix.inv": _m(linalg.inv), "matrix.pinv": _m(linalg.pinv),
    "matrix.eigenvalues": _m(lambda a: linalg.eigen(a)[0]), "matrix.eigenvectors": _m(lambda a: linalg.eigen(a)[1]),
}
for _n, _f in {"sum": lambda v: float(sum(v)), "avg": K.mean, "min": min, "max": max, "median": lambda v: K.pct_linear(v, 50), "mode": _mode}.items():
    PURE[f"matrix.{_n}"] = lambda m, _f=_f: _f(m.a.ravel().tolist()) if m.a.size else None
for _n in ("square", "symmetric", "diagonal", "identity", "zero", "triangular", "binary", "antidiagonal", "antisymmetric", "stochastic"):
    PURE[f"matrix.is_{_n}"] = _is(_n)
for _n in ("", "_float", "_int", "_bool", "_string"):
    PURE[f"matrix.new{_n}"] = lambda r=0, c=0, v=0.0: Matrix(np.full((int(r), int(c)), number(v) if number(v) is not None else np.nan))


# --- indicators: (made from constants, inputs taken from each bar) ---


class Barssince:
    def __init__(self):
        self.n = None

    def __call__(self, cond):
        self.n = 0.0 if truth(cond) else None if self.n is None else self.n + 1
        return self.n


class Valuewhen:
    def __init__(self, occurrence):
        self.held, self.n = [], int(occurrence)

    def __call__(self, cond, x):
        if truth(cond):
            self.held = [*self.held[-self.n :], x] if self.n else [x]
        return self.held[-self.n - 1] if len(self.held) > self.n else None


class Cross:
    def __init__(self, over=True, under=True):
        self.over, self.under, self.last = over, under, None

    def __call__(self, a, b):
        last, self.last = self.last, (a, b)
        if last is None or None in (a, b, *last):
            return False
        return self.over and last[0] <= last[1] and a > b or self.under and last[0] >= last[1] and a < b


class Total:
    def __init__(self, f):
        self.f, self.v = f, None

    def __call__(self, x):
        if x is not None:
            self.v = x if self.v is None else self.f(self.v, x)
        return self.v


class Change:
    def __init__(self, n=1, f=lambda x, y: x - y):
        self.lag, self.f = K.Lag(int(n)), f

    def __call__(self, x):
        y = self.lag(x)
        return None if x is None or y is None else self.f(x, y)


def _trend(up):
    def run(v):
        if len(v) <= 1:
            return False
        return v[-1] > max(v[:-1]) if up else v[-1] < min(v[:-1])

    return run


def _flag(step):
    return lambda *x: bool(step(*x))


def _bars(pick):
    return lambda v: float(min(len(v) - 1 - i for i, x in enumerate(v) if x == pick(v)))


def _pivot(pick, left, right):
    left, right = int(left), int(right)
    return K.Rolling(left + right + 1, lambda v: v[left] if v[left] == pick(v) else None)


class Levels:
    def __init__(self):
        self.last = None

    def __call__(self, h, l, c):  # noqa: E741
        h0, l0, c0 = self.last or (h, l, c)
        self.last = (h, l, c)
        p = (h0 + l0 + c0) / 3
        return [p, 2 * p - l0, p + (h0 - l0), h0 + 2 * (p - l0), 2 * p - h0, p - (h0 - l0), l0 - 2 * (h0 - p)]


def _listed(step, n):
    def run(*x):
        out = step(*x)
        return list(out) if out is not None else [None] * n

    return run


def _kcw(n, mult, tr=True):
    inner = K.Kc(int(n), mult, tr)

    def step(*x):
        mid, up, low = inner(*x)
        return (up - low) / mid if mid else None

    return step


R = lambda n, f: K.Rolling(int(n), f)
M = lambda n, f: K.Sums(int(n), f)
HLC = ("high", "low", "close")
#: name: (number of series arguments, price inputs added, maker of the constants)
STATEFUL: dict = {
    "sma": (1, (), lambda n: M(n, K.Sums.mean)), "ema": (1, (), lambda n: K.Ema(int(n))), "rma": (1, (), lambda n: K.Rma(int(n))),
    "wma": (1, (), lambda n: R(n, K.wma)), "swma": (1, (), lambda: R(4, lambda v: (v[0] + 2 * v[1] + 2 * v[2] + v[3]) / 6)),
    "hma": (1, (), lambda n: K.Chain(int(n))), "alma": (1, (), lambda n, o=0.85, s=6.0, f=False: R(n, lambda v: K.alma(v, o, s, f))),
    "linreg": (1, (), lambda n, o=0.0: R(n, lambda v: K.linreg(v, o))),
    "vwma": (1, ("volume",), lambda n: R(n, lambda p: sum(a * b for a, b in p) / sum(b for _, b in p) if sum(b for _, b in p) else None)),
    "rsi": (1, (), lambda n: R(n + 1, K.rsi)), "cci": (1, (), lambda n: R(n, K.cci)), "cmo": (1, (), lambda n: R(n + 1, K.cmo)),
    "cog": (1, (), lambda n: R(n, K.cog)), "macd": (1, (), lambda f, s, g: _listed(K.Macd(int(f), int(s), int(g)), 3)),
    "mom": (1, (), lambda n: Change(n)), "roc": (1, (), lambda n: Change(n, lambda x, y: 100 * (x - y) / y if y else None)),
    "change": (1, (), lambda n=1: Change(n)),
    "stoch": (3, (), lambda n: R(n, lambda p: (lambda hh, ll: 100 * (p[-1][0] - ll) / (hh - ll) if hh != ll else None)(max(x[1] for x in p), min(x[2] for x in p)))),
    "mfi": (1, ("volume",), lambda n: R(n + 1, K.mfi)), "tsi": (1, (), lambda s, n: K.Tsi(int(s), int(n))),
    "wpr": (0, HLC, lambda n: R(n, lambda p: (lambda hh, ll: -100 * (hh - p[-1][2]) / (hh - ll) if hh != ll else None)(max(x[0] for x in p), min(x[1] for x in p)))),
    "dmi": (0, HLC, lambda d, a: _listed(K.Dmi(int(d), int(a)), 3)), "atr": (0, HLC, lambda n: K.Atr(int(n))), "tr": (0, HLC, lambda *_: K.Tr()),
    "bb": (1, (), lambda n, m: _listed(M(n, lambda v: v.bands(m)), 3)), "bbw": (1, (), lambda n, m: M(n, lambda v: (lambda b: (b[1] - b[2]) / b[0] if b[0] else None)(v.bands(m)))),
    "kc": (1, HLC, lambda n, m, t=True: _listed(K.Kc(int(n), m, t), 3)), "kcw": (1, HLC, _kcw),
    "sar": (0, ("high", "low"), lambda s, i, m: K.Sar(s, i, m)), "supertrend": (0, HLC, lambda f, n: _listed(K.Supertrend(f, int(n)), 2)),
    "stdev": (1, (), lambda n, b=True: M(n, lambda v: v.stdev(b))), "variance": (1, (), lambda n, b=True: M(n, lambda v: v.var(b))),
    "dev": (1, (), lambda n: R(n, K.mad)), "correlation": (2, (), lambda n: M(n, K.Sums.correlation) if n > 1 else lambda *_: None),
    "highest": (1, (), lambda n: K.Extreme(int(n))), "lowest": (1, (), lambda n: K.Extreme(int(n), -1.0)), "max": (1, (), lambda: Total(max)), "min": (1, (), lambda: Total(min)),
    "highestbars": (1, (), lambda n: R(n, _bars(max))), "lowestbars": (1, (), lambda n: R(n, _bars(min))),
    "median": (1, (), lambda n: R(n, lambda v: K.pct_linear(v, 50))), "mode": (1, (), lambda n: R(n, K.mode)),
    "percentile_linear_interpolation": (1, (), lambda n, p: R(n, lambda v: K.pct_linear(v, p))),
    "percentile_nearest_rank": (1, (), lambda n, p: R(n, lambda v: K.pct_nearest(v, p))),
    "percentrank": (1, (), lambda n: R(n, lambda v: 100 * (sum(x <= v[-1] for x in v) - 1) / (len(v) - 1) if len(v) > 1 else None)),
    "range": (1, (), lambda n: R(n, lambda v: max(v) - min(v))), "rising": (1, (), lambda n: _flag(R(n, _trend(True)))), "falling": (1, (), lambda n: _flag(R(n, _trend(False)))),
    "pivothigh": (1, (), lambda left, right: _pivot(max, left, right)), "pivotlow": (1, (), lambda left, right: _pivot(min, left, right)),
    "pivot_point_levels": (0, HLC, lambda *_: Levels()),
    "crossover": (2, (), lambda: Cross(under=False)), "crossunder": (2, (), lambda: Cross(over=False)), "cross": (2, (), lambda: Cross()),
    "barssince": (1, (), lambda: Barssince()), "cum": (1, (), lambda: Total(lambda a, b: a + b)), "valuewhen": (2, (), lambda n=0: Valuewhen(n)),
}
#: Names that also work without their prefix.
BARE = {n for n in STATEFUL if n not in ("max", "min", "median", "mode", "range", "variance", "dev", "rising", "falling", "pivothigh", "pivotlow", "pivot_point_levels", "percentrank", "percentile_linear_interpolation", "percentile_nearest_rank")}
#: Series that a call with only its lengths reads.
DEFAULT_SERIES = {"highestbars": ("high", 1), "lowestbars": ("low", 1), "pivothigh": ("high", 2), "pivotlow": ("low", 2)}
