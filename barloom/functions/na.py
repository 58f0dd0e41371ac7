"""Missing values: ``na`` is stored as NULL, never as NaN.

Comparisons with na are false, ``!=`` with na is true, arithmetic with na is na,
division by zero is na, and the truth of na is false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def truthy(c: Column) -> Column:
    return F.coalesce(c.cast("double") != 0, F.lit(False))


def lt(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, F.lit(False))


def le(a: Column, b: Column) -> Column:
    return F.coalesce(a <= b, F.lit(False))


def eq(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; na for a zero divisor."""
    return a % F.nullif(b, F.lit(0.0))


def every(*args: Column) -> Column:
    out = args[0].isNotNull()
    for a in args[1:]:
        out = out & a.isNotNull()
    return out


def vmax(*args: Column) -> Column:
    """Largest argument; na if any is na."""
    return F.when(every(*args), F.greatest(*args)) if len(args) > 1 else args[0]


def vmin(*args: Column) -> Column:
    return F.when(every(*args), F.least(*args)) if len(args) > 1 else args[0]


def na(c: Column) -> Column:
    return c.isNull()


def nz(c: Column, other: Column | float = 0.0) -> Column:
    return F.coalesce(c, other if isinstance(other, Column) else F.lit(other))


def fixnan(c: Column) -> Column:
    """The value as it is; ``ffill`` carries values forward."""
    return c
