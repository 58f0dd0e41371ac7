"""Arrays, maps and matrices as immutable Columns: a mutation is the new value.

Arrays are ``array<double>`` unless told otherwise, maps ``map<string,double>``,
matrices ``array<array<double>>``. Indexes count from 0; an index out of range
is an error where the language says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import to_text

D0 = 0.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _fail(text: str) -> Column:
    return F.raise_error(F.lit(text))


def _checked(a: Column, i: Column, value: Column, kind: str = "double") -> Column:
    return F.when((i >= 0) & (i < F.size(a)), value).otherwise(_fail("array index out of range").cast(kind))


# --- arrays ---


def new(size: int, init=None, kind: str = "double") -> Column:
    return F.array_repeat(F.lit(init).cast(kind), size)


size = F.size
from_ = F.array
concat = F.concat


def get(a: Column, i) -> Column:
    i = _c(i)
    return _checked(a, i, F.get(a, i))


def set_(a: Column, i, v) -> Column:
    i, v = _c(i), _c(v)
    out = F.transform(a, lambda x, j: F.when(j == i, v).otherwise(x))
    return F.when((i >= 0) & (i < F.size(a)), out).otherwise(_fail("array index out of range").cast("array<double>"))


def push(a: Column, v) -> Column:
    return F.array_append(a, _c(v))


def unshift(a: Column, v) -> Column:
    return F.array_prepend(a, _c(v))


def first(a: Column) -> Column:
    return _checked(a, F.lit(0), F.get(a, F.lit(0)))


def last(a: Column) -> Column:
    return _checked(a, F.lit(0), F.get(a, F.size(a) - 1))


def pop(a: Column) -> tuple[Column, Column]:
    """The last value, and the array without it."""
    return last(a), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a: Column) -> tuple[Column, Column]:
    return first(a), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def remove(a: Column, i) -> tuple[Column, Column]:
    i = _c(i)
    return get(a, i), F.filter(a, lambda x, j: j != i)


def insert(a: Column, i, v) -> Column:
    i = _c(i)
    out = F.concat(F.slice(a, F.lit(1), i), F.array(_c(v)), F.slice(a, i + 1, F.size(a)))
    return F.when((i >= 0) & (i <= F.size(a)), out).otherwise(_fail("array index out of range").cast("array<double>"))


def clear(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.lit(0))


def copy(a: Column) -> Column:
    return a


def slice_(a: Column, start: int, end: int | None = None) -> Column:
    """Values from start to before end, clamped."""
    start = max(0, start)
    n = F.size(a) - start if end is None else F.lit(max(end - start, 0))
    return F.slice(a, F.lit(start + 1), F.greatest(n, F.lit(0)))


def includes(a: Column, v) -> Column:
    return F.coalesce(F.array_contains(a, _c(v)), F.lit(False))


def indexof(a: Column, v) -> Column:
    return (F.array_position(a, _c(v)) - 1).cast("double")


def lastindexof(a: Column, v) -> Column:
    at = F.array_position(F.reverse(a), _c(v))
    return F.when(at == 0, -1.0).otherwise((F.size(a) - at).cast("double"))


binary_search_leftmost = indexof
binary_search_rightmost = lastindexof


def join(a: Column, sep: str) -> Column:
    return F.array_join(F.transform(a, to_text), sep)


def every(a: Column, v=None) -> Column:
    """All truthy, or all equal to v."""
    return F.forall(a, (lambda x: F.coalesce(x != 0, F.lit(False))) if v is None else (lambda x: F.coalesce(x == _c(v), F.lit(False))))


def abs_(a: Column) -> Column:
    return F.transform(a, F.abs)


def sum_(a: Column) -> Column:
    return F.aggregate(a, F.lit(D0), lambda s, x: s + x)


def avg(a: Column) -> Column:
    return F.try_divide(sum_(a), F.size(a))


def max_(a: Column, nth: int = 0) -> Column:
    return F.get(F.sort_array(a, False), F.lit(nth))


def min_(a: Column, nth: int = 0) -> Column:
    return F.get(F.sort_array(a), F.lit(nth))


def range_(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def median(a: Column) -> Column:
    return percentile_linear(a, 50.0)


def mode(a: Column) -> Column:
    """Most frequent value, the smallest of equals."""
    n = lambda x: -F.size(F.filter(a, lambda y: y == x))
    return F.array_min(F.transform(F.array_distinct(a), lambda x: F.struct(n(x).alias("n"), x.alias("x"))))["x"]


def percentrank(a: Column, i) -> Column:
    below = F.size(F.filter(a, lambda x: x <= F.get(a, _c(i))))
    return F.when(F.size(a) > 1, 100.0 * (below - 1) / (F.size(a) - 1))


def percentile_linear(a: Column, p: float) -> Column:
    s = F.sort_array(a)
    at = F.lit(p / 100) * (F.size(a) - 1)
    lo = F.floor(at).cast("int")
    x, y = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(a) - 1))
    return F.when(F.size(a) > 0, x + (at - lo) * (y - x))


def percentile_nearest(a: Column, p: float) -> Column:
    at = F.least(F.greatest(F.ceil(F.lit(p / 100) * F.size(a)).cast("int"), F.lit(1)), F.size(a))
    return F.get(F.sort_array(a), at - 1)


def covariance(a: Column, b: Column, biased: bool = True) -> Column:
    pair = F.zip_with(a, b, lambda x, y: (x - avg(a)) * (y - avg(b)))
    n = F.size(a) - (0 if biased else 1)
    return F.when(F.size(a) == F.size(b), F.try_divide(sum_(pair), n))


# --- maps ---


def map_new() -> Column:
    return F.create_map().cast("map<string,double>")


def map_put(m: Column, k, v) -> Column:
    rest = F.map_filter(m, lambda a, _: a != _c(k))
    return F.map_concat(rest, F.create_map(_c(k), _c(v)))


def map_get(m: Column, k) -> Column:
    return F.try_element_at(m, _c(k))


map_contains = F.map_contains_key


def map_remove(m: Column, k) -> Column:
    return F.map_filter(m, lambda a, _: a != _c(k))


def map_size(m: Column) -> Column:
    return F.size(m).cast("double")


def map_clear(m: Column) -> Column:
    return F.map_filter(m, lambda a, _: F.lit(False))


def map_copy(m: Column) -> Column:
    return m


def map_keys(m: Column) -> Column:
    """Keys in order of their text."""
    return F.array_sort(F.map_keys(m))


def map_values(m: Column) -> Column:
    """Values in the order of ``map_keys``."""
    return F.transform(map_keys(m), lambda k: F.element_at(m, k))


# --- matrices ---


def m_new(rows: int, cols: int, fill: float = 0.0) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(float(fill)), cols), rows)


def m_from(*rows) -> Column:
    return F.array(*(F.array(*map(_c, r)) for r in rows))


def m_rows(m: Column) -> Column:
    return F.size(m)


def m_cols(m: Column) -> Column:
    return F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))


def m_count(m: Column) -> Column:
    return m_rows(m) * m_cols(m)


def m_get(m: Column, r: int, c: int) -> Column:
    ok = (F.lit(r) >= 0) & (F.lit(r) < m_rows(m)) & (F.lit(c) >= 0) & (F.lit(c) < m_cols(m))
    return F.when(ok, F.get(F.get(m, F.lit(r)), F.lit(c))).otherwise(_fail("matrix index out of range").cast("double"))


def m_fill(m: Column, v, r0: int = 0, r1: int | None = None, c0: int = 0, c1: int | None = None) -> Column:
    """v in rows r0 to before r1 and columns c0 to before c1."""
    rows, cols = (m_rows(m) if r1 is None else F.lit(r1)), (m_cols(m) if c1 is None else F.lit(c1))
    inside = lambda i, j: (i >= r0) & (i < rows) & (j >= c0) & (j < cols)
    return F.transform(m, lambda row, i: F.transform(row, lambda x, j: F.when(inside(i, j), _c(v)).otherwise(x)))


def m_set(m: Column, r: int, c: int, v) -> Column:
    return m_fill(m, v, r, r + 1, c, c + 1)


def m_row(m: Column, r: int) -> Column:
    return F.get(m, F.lit(r))


def m_col(m: Column, c: int) -> Column:
    return F.transform(m, lambda row: F.get(row, F.lit(c)))


def m_copy(m: Column) -> Column:
    return m


def m_reshape(m: Column, r: int, c: int) -> Column:
    flat = F.flatten(m)
    out = F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda i: F.slice(flat, i * c + 1, F.lit(c)))
    return F.when(F.size(flat) == r * c, out).otherwise(_fail("matrix size mismatch").cast("array<array<double>>"))


def m_sub(m: Column, r0: int, r1: int, c0: int, c1: int) -> Column:
    return F.transform(F.slice(m, r0 + 1, r1 - r0), lambda row: F.slice(row, c0 + 1, c1 - c0))


def m_add_row(m: Column, row: Column, i: int | None = None) -> Column:
    at = F.size(m) if i is None else F.lit(i)
    return F.concat(F.slice(m, F.lit(1), at), F.array(row), F.slice(m, at + 1, F.size(m) + 1))


def m_add_col(m: Column, col: Column, i: int | None = None) -> Column:
    at = m_cols(m) if i is None else F.lit(i)
    return F.zip_with(m, col, lambda row, x: F.concat(F.slice(row, F.lit(1), at), F.array(x), F.slice(row, at + 1, F.size(row) + 1)))


def m_remove_row(m: Column, i: int) -> Column:
    return F.filter(m, lambda _, j: j != i)


def m_remove_col(m: Column, i: int) -> Column:
    return F.transform(m, lambda row: F.filter(row, lambda _, j: j != i))


def _swap(a: Column, i: int, j: int) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, F.get(a, F.lit(j))).when(k == j, F.get(a, F.lit(i))).otherwise(x))


def m_swap_rows(m: Column, i: int, j: int) -> Column:
    return _swap(m, i, j)


def m_swap_cols(m: Column, i: int, j: int) -> Column:
    return F.transform(m, lambda row: _swap(row, i, j))


def m_reverse(m: Column) -> Column:
    return F.reverse(F.transform(m, lambda row: F.reverse(row)))


def m_sort(m: Column) -> Column:
    """All elements ascending, row by row."""
    flat, c = F.sort_array(F.flatten(m)), m_cols(m)
    return F.transform(m, lambda _, i: F.slice(flat, i * c + 1, c))


def m_stat(m: Column, f) -> Column:
    """An array statistic over all elements: sum_, avg, min_, max_, median or mode."""
    return f(F.flatten(m))


def m_concat(a: Column, b: Column) -> Column:
    """Side by side if the rows agree, else one below the other."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.concat(x, y))).otherwise(F.concat(a, b))


def m_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p - q))


def m_transpose(m: Column) -> Column:
    return F.transform(F.get(m, F.lit(0)), lambda _, j: F.transform(m, lambda row: F.get(row, j)))


def m_mult(a: Column, b: Column) -> Column:
    bt = m_transpose(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(D0), lambda s, v: s + v)
    return F.transform(a, lambda row: F.transform(bt, lambda col: dot(row, col)))


def m_kron(a: Column, b: Column) -> Column:
    block = lambda ra, rb: F.flatten(F.transform(ra, lambda x: F.transform(rb, lambda y: x * y)))
    return F.flatten(F.transform(a, lambda ra: F.transform(b, lambda rb: block(ra, rb))))


def m_trace(m: Column) -> Column:
    return F.aggregate(F.transform(m, lambda row, i: F.get(row, i)), F.lit(D0), lambda s, x: s + x)


def _all(m: Column, test) -> Column:
    return F.forall(F.transform(m, lambda row, i: F.forall(F.transform(row, lambda x, j: test(x, i, j)), lambda b: b)), lambda b: b)


EPS, EPS_SUM = 1e-9, 1e-6  # fixed values of the predicates


def m_is(m: Column, kind: str) -> Column:
    """is_square, symmetric, diagonal, identity, zero, triangular, binary, antidiagonal, antisymmetric, stochastic."""
    near = lambda x, y: F.abs(x - y) <= EPS
    zero = lambda x: F.abs(x) <= EPS
    square, n = m_rows(m) == m_cols(m), m_rows(m)
    other = lambda i, j: F.get(F.get(m, j), i)
    if kind == "square":
        return square
    if kind == "symmetric":
        return square & F.coalesce(_all(m, lambda x, i, j: near(x, other(i, j))), F.lit(False))
    if kind == "antisymmetric":
        return square & F.coalesce(_all(m, lambda x, i, j: near(x, -other(i, j))), F.lit(False))
    if kind == "diagonal":
        return square & _all(m, lambda x, i, j: (i == j) | zero(x))
    if kind == "identity":
        return square & _all(m, lambda x, i, j: near(x, F.when(i == j, 1.0).otherwise(0.0)))
    if kind == "zero":
        return _all(m, lambda x, i, j: zero(x))
    if kind == "triangular":
        return square & (_all(m, lambda x, i, j: (i <= j) | zero(x)) | _all(m, lambda x, i, j: (i >= j) | zero(x)))
    if kind == "binary":
        return _all(m, lambda x, i, j: zero(x) | near(x, F.lit(1.0)))
    if kind == "antidiagonal":
        return square & _all(m, lambda x, i, j: (i + j == n - 1) | zero(x))
    if kind == "stochastic":
        sums = F.forall(m, lambda row: F.abs(sum_(row) - 1) <= EPS_SUM)
        return square & sums & _all(m, lambda x, i, j: x >= -EPS)
    raise ValueError(kind)
