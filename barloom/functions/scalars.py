"""Casts, math, strings, time frames and drawing placeholders as Column functions."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .na import clean, vmax, vmin

# --- casts and inputs ---


def to_int(c: Column) -> Column:
    """Truncated toward zero."""
    c = clean(c)
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long")


def to_float(c: Column) -> Column:
    return clean(c)


def to_bool(c: Column, text: bool = False) -> Column:
    """False for na, 0 and the empty string."""
    return F.coalesce(c != (F.lit("") if text else F.lit(0)), F.lit(False))


def to_text(c: Column) -> Column:
    """A number as text: integers without a point, the shortest digits otherwise, an exponent from 1e6 on or under 1e-4."""
    # A lambda holds the number: Spark writes a column's code out at every use, and the JVM runs methods over 8,000 bytes uncompiled
    return F.coalesce(F.transform(F.array(clean(c)), _digits)[0], F.lit("na"))


def _digits(c: Column) -> Column:
    a = F.abs(c)
    java = c.cast("string")  # d.dEx under 1e-3 and from 1e7 on
    plain = F.when(F.rint(c) == c, c.cast("long").cast("string")).otherwise(java)
    millions = F.concat(F.regexp_replace(F.rtrim(F.translate(java, ".", ""), F.lit("0")), "^(-?[0-9])(?=[0-9])", "$1."), F.lit("e+06"))
    small = F.regexp_replace(java, "([0-9])\\.(0|([0-9]+))E-4", "0.000$1$3")
    mark = F.when(a < 1e-9, "e-").when(a < 1, "e-0").when(a < 1e10, "e+0").otherwise("e+")
    return (
        F.when((c == 0) | (a >= 1e-3) & (a < 1e6), plain)
        .when((a >= 1e-4) & (a < 1), small)
        .when((a >= 1) & (a < 1e7), millions)
        .when(a == float("inf"), F.when(c < 0, "-Inf").otherwise("+Inf"))
        .otherwise(F.regexp_replace(java, F.lit("(\\.0)?E-?"), mark))
    )


DEFAULTS = {"int": 0, "float": 0.0, "bool": False, "string": "", "color": "", "time": 0, "session": "", "symbol": "", "source": None}


def input_(default=None, kind: str = "float", value=None) -> Column:
    """A query parameter: the value given, else the default, else the kind's empty value."""
    picked = value if value is not None else default if default is not None else DEFAULTS[kind]
    return F.lit(picked)


# --- math ---

E, PI, PHI, RPHI = math.e, math.pi, (1 + math.sqrt(5)) / 2, (math.sqrt(5) - 1) / 2

abs_ = F.abs
max_ = vmax
min_ = vmin


def round_(c: Column) -> Column:
    """Half away from zero."""
    return F.signum(c) * F.floor(F.abs(c) + 0.5).cast("double")


def floor_(c: Column) -> Column:
    return F.floor(c).cast("double")


def ceil_(c: Column) -> Column:
    return F.ceil(c).cast("double")


def pow_(a: Column, b: Column) -> Column:
    return clean(F.pow(a, b))


def sqrt_(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def log_(c: Column) -> Column:
    """Natural logarithm; minus infinity at 0, na below."""
    return F.when(c == 0, F.lit(float("-inf"))).otherwise(F.ln(c))


def log10_(c: Column) -> Column:
    return F.when(c == 0, F.lit(float("-inf"))).otherwise(F.log10(c))


def avg_(*args: Column) -> Column:
    """Mean of the arguments."""
    return sum_(*args) / len(args)


def sum_(*args: Column) -> Column:
    out = args[0]
    for a in args[1:]:
        out = out + a
    return out


exp_, sin_, cos_, tan_, atan_ = F.exp, F.sin, F.cos, F.tan, F.atan


def acos_(c: Column) -> Column:
    return F.when(F.abs(c) <= 1, F.acos(c))


def asin_(c: Column) -> Column:
    return F.when(F.abs(c) <= 1, F.asin(c))


sign_, todegrees, toradians = F.signum, F.degrees, F.radians


def random_(lo: float = 0.0, hi: float | None = None, seed: int | None = None) -> Column:
    """Uniform; one argument is the upper end, ends in the wrong order are swapped."""
    lo, hi = (0.0, lo if lo else 1.0) if hi is None else (min(lo, hi), max(lo, hi))
    return F.rand(seed) * (hi - lo) + lo


def clamp(c: Column, lo: Column, hi: Column) -> Column:
    """max(min(c, hi), lo); na passes through."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo))


# --- strings ---


def length(s: Column) -> Column:
    return F.char_length(s).cast("double")


upper, lower = F.upper, F.lower


def contains(s: Column, sub: Column) -> Column:
    return F.coalesce(F.contains(s, sub), F.lit(False))


def startswith(s: Column, p: Column) -> Column:
    return F.coalesce(F.startswith(s, p), F.lit(False))


def endswith(s: Column, p: Column) -> Column:
    return F.coalesce(F.endswith(s, p), F.lit(False))


def replace(s: Column, old: Column, new: Column) -> Column:
    """Every occurrence."""
    return F.replace(s, old, new)


def substring(s: Column, start: int, end: int | None = None) -> Column:
    """Characters from start (0-based) to before end, clamped."""
    start = max(0, start)
    n = F.char_length(s) - start if end is None else F.lit(max(end - start, 0))
    return F.substr(s, F.lit(start + 1), F.greatest(n, F.lit(0)))


def split(s: Column, sep: str) -> Column:
    """A literal separator; an empty one cuts between characters."""
    return F.split(s, re.escape(sep)) if sep else F.filter(F.split(s, ""), lambda x: x != "")


def number_pattern(c: Column, pattern: str) -> Column:
    """A number by a pattern like #.## or 0.00: at most or exactly so many decimals, rounded half away."""
    part = pattern.partition(".")[2]
    least, most = part.count("0"), len(part)
    text = F.format_string(f"%.{most}f", round_(c * 10**most) / 10**most if most <= 6 else c)
    if most > least:
        keep = f"\\.([0-9]{{{least}}}[0-9]*?)0*$" if least else "\\.([0-9]*?)0*$"
        text = F.regexp_replace(text, keep, ".$1")
        text = F.regexp_replace(text, "\\.$", "")
    return F.coalesce(text, F.lit("na"))


def format_(template: str, *args: Column) -> Column:
    """``{i}`` and ``{i,number,pattern}`` filled in; ``{{`` and ``}}`` are braces; an unknown index stays as written."""
    parts: list[Column] = []
    for m in re.finditer(r"\{\{|\}\}|\{(\d+)(?:,\s*number\s*(?:,\s*([^{}]*))?)?\}|[^{}]+|[{}]", template):
        token = m.group(0)
        if token in ("{{", "}}"):
            parts.append(F.lit(token[0]))
        elif m.group(1) is not None and int(m.group(1)) < len(args):
            arg = args[int(m.group(1))]
            parts.append(number_pattern(arg, m.group(2)) if m.group(2) else arg if _is_text(arg) else to_text(arg))
        else:
            parts.append(F.lit(token))
    return F.concat(*parts) if parts else F.lit("")


def text_arg(c: Column) -> Column:
    """Marks a string column as an argument of ``format_``."""
    out = F.coalesce(c, F.lit("na"))
    out._is_text = True
    return out


def _is_text(c: Column) -> bool:
    return getattr(c, "_is_text", False)


# --- time frames ---

#: Seconds of a time-frame unit; a month is 30 days.
UNIT_SECONDS = {"S": 1, "": 60, "H": 3600, "D": 86400, "W": 604800, "M": 2592000}


def in_seconds(frame: str) -> float | None:
    """Seconds of a time frame: digits alone are minutes, M is months, T (ticks) has none; case doesn't matter."""
    m = re.fullmatch(r"(\d*)([SHDWMT]?)", frame.strip().upper())
    if not m or not m.group(0) or m.group(2) == "T":
        return None
    return float(int(m.group(1) or 1) * UNIT_SECONDS[m.group(2)])


def from_seconds(seconds: float) -> str:
    """The largest unit that divides: months, weeks, days, minutes, seconds."""
    s = int(seconds)
    for unit, size in (("M", 2592000), ("W", 604800), ("D", 86400)):
        if s >= size and s % size == 0:
            return f"{s // size}{unit}"
    return str(s // 60) if s >= 60 and s % 60 == 0 else f"{s}S"


def timeframe_change(bar_index: Column, current: str, target: str) -> Column:
    """By counting bars: true on each bar that completes a target period; always if target isn't longer."""
    a, b = in_seconds(current), in_seconds(target)
    if not a or not b or b <= a:
        return F.lit(True)
    return (bar_index + 1) % math.ceil(b / a) == 0


def bar_open(bar_index: Column, start: datetime, frame: str) -> Column:
    """Opening time by the synthetic clock: start plus bars times the frame."""
    step = int((in_seconds(frame) or 60) * 1000)
    return F.timestamp_millis((F.lit(int(start.replace(tzinfo=start.tzinfo or UTC).timestamp() * 1000)) + bar_index * step).cast("long"))


def time_(opened: Column) -> Column:
    return F.unix_millis(opened).cast("double")


def time_close(opened: Column, frame: str) -> Column:
    return time_(opened) + (in_seconds(frame) or 60) * 1000


def timenow(now: datetime | None = None) -> Column:
    return F.lit((now or datetime.now(UTC)).timestamp() * 1000)


def time_tradingday(opened: Column) -> Column:
    return F.unix_millis(F.date_trunc("day", opened)).cast("double")


def parts(opened: Column) -> dict[str, Column]:
    """year, month, dayofmonth, dayofweek (Sunday is 1), hour, minute, second."""
    names = {"year": F.year, "month": F.month, "dayofmonth": F.dayofmonth, "dayofweek": F.dayofweek, "hour": F.hour, "minute": F.minute, "second": F.second}
    return {k: f(opened).cast("double") for k, f in names.items()}


def timestamp(*args) -> float:
    """Epoch milliseconds of ([zone,] year, month, day[, hour, minute, second]); overflowing parts carry, unknown zones are UTC."""
    from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

    zone = UTC
    if isinstance(args[0], str):
        name, args = args[0], args[1:]
        m = re.fullmatch(r"(?:UTC|GMT)([+-])(\d{1,2})(?::?(\d{2}))?", name.upper())
        if m:
            minutes = int(m.group(2)) * 60 + int(m.group(3) or 0)
            zone = timezone(timedelta(minutes=-minutes if m.group(1) == "-" else minutes))
        else:
            try:
                zone = ZoneInfo(name)
            except (ZoneInfoNotFoundError, ValueError):
                zone = UTC
    y, mo, d, *rest = (int(a) for a in args)
    h, mi, s = (rest + [0, 0, 0])[:3]
    y, mo = y + (mo - 1) // 12, (mo - 1) % 12 + 1
    at = datetime(y, mo, 1, tzinfo=zone) + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s)
    return at.timestamp() * 1000


# --- drawing placeholders: plain structs, nothing is rendered ---


def color(r, g, b) -> Column:
    return F.struct(*(F.lit(float(x)).alias(n) for x, n in ((r, "r"), (g, "g"), (b, "b"))))


color_rgb = color


def color_new(base: str, transp: float = 0.0) -> Column:
    return F.struct(F.lit(base).alias("base"), F.lit(float(transp)).alias("transp"))


def box_new(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(F.lit("box").alias("type"), left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def box_get_top(b: Column) -> Column:
    return b["top"]


def box_get_bottom(b: Column) -> Column:
    return b["bottom"]


def box_set_right(b: Column, x: Column) -> Column:
    return b.withField("right", x)


def box_delete(b: Column) -> Column:
    return b


def shape(kind: str, **fields) -> Column:
    """line.new, label.new, table.new and linefill.new: a struct with its kind and fields."""
    return F.struct(F.lit(kind).alias("type"), *((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))


def set_fields(obj: Column, **fields) -> Column:
    """line.set_xy1/xy2/color and label.set_xy/text/tooltip: the struct with fields set."""
    for k, v in fields.items():
        obj = obj.withField(k, v if isinstance(v, Column) else F.lit(v))
    return obj
