"""Whole columns of rolling indicators with numpy; NaN stands for na.

The same results as the machines of ``kernels``, for a symbol's (or a segment's)
bars at once. Windows are taken in pieces, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

PIECE = 1 << 16
_BLOCK = 64


def windows(n: int, f: Callable, *columns: np.ndarray) -> list[np.ndarray]:
    """Applies f to (rows, n) windows of the columns; the first n - 1 rows are NaN."""
    size = len(columns[0])
    if n <= 0 or size < n:
        return [np.full(size, np.nan) for _ in f(*(np.zeros((1, 1)) for _ in columns))]
    views = [np.lib.stride_tricks.sliding_window_view(c, n) for c in columns]
    parts = [f(*(v[at : at + PIECE] for v in views)) for at in range(0, size - n + 1, PIECE)]
    return [np.concatenate([np.full(n - 1, np.nan), *column]) for column in zip(*parts, strict=True)]


def sma(n: int) -> Callable:
    return lambda x: windows(n, lambda w: [w.mean(axis=1)], x)


def _spread(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = w.mean(axis=1)
    off = w - mean[:, None]
    return mean, off, np.einsum("ij,ij->i", off, off)


def stdev(n: int, biased: bool = True) -> Callable:
    def run(w):
        count = w.shape[1] - (not biased)
        return [np.sqrt(_spread(w)[2] / count) if count else np.full(len(w), np.nan)]

    return lambda x: windows(n, run, x)


def bb(n: int, mult: float) -> Callable:
    def run(w):
        mean, _, square = _spread(w)
        d = mult * np.sqrt(square / w.shape[1])
        return [mean, mean + d, mean - d]

    return lambda x: windows(n, run, x)


def correlation(n: int) -> Callable:
    def run(a, b):
        (_, p, pp), (_, q, qq) = _spread(a), _spread(b)
        den = np.sqrt(pp * qq)
        return [np.divide(np.einsum("ij,ij->i", p, q), den, out=np.full(len(den), np.nan), where=den > 0)]

    return lambda x, y: windows(n, run, x, y) if n > 1 else [np.full(len(x), np.nan)]


def highest(n: int) -> Callable:
    return lambda x: windows(n, lambda w: [w.max(axis=1)], x)


def lowest(n: int) -> Callable:
    return lambda x: windows(n, lambda w: [w.min(axis=1)], x)


def linear(x: np.ndarray, k: float, start: float) -> np.ndarray:
    """y[i] = x[i] * k + y[i - 1] * (1 - k), with ``start`` before the first; block by block.

    Within a block y is a triangular product, and only the blocks' ends follow one another.
    """
    n, keep = len(x), 1 - k
    power = keep ** np.arange(_BLOCK + 1)
    gap = np.arange(_BLOCK)[:, None] - np.arange(_BLOCK)[None, :]
    lower = np.where(gap >= 0, k * power[np.abs(gap)], 0.0)
    padded = np.zeros(-(-n // _BLOCK) * _BLOCK)
    padded[:n] = x
    own = padded.reshape(-1, _BLOCK) @ lower.T
    before, carry = np.empty(len(own)), start
    for i, last in enumerate(own[:, -1].tolist()):
        before[i] = carry
        carry = last + carry * power[_BLOCK]
    return (own + before[:, None] * power[1:]).ravel()[:n]


def _from(y: np.ndarray, n: int) -> np.ndarray:
    y = y.copy()
    y[: n - 1] = np.nan
    return y


def _seeded(x: np.ndarray, k: float) -> np.ndarray:
    return np.concatenate([x[:1], linear(x[1:], k, x[0])])


def ema(n: int) -> Callable:
    def run(x):
        if n <= 0 or not len(x):
            return [np.full(len(x), np.nan)]
        return [_from(_seeded(x, 2 / (n + 1)), n)]

    return run


def rma(n: int) -> Callable:
    def run(x):
        if n <= 0 or len(x) < n:
            return [np.full(len(x), np.nan)]
        first = x[:n].mean()
        return [np.concatenate([np.full(n - 1, np.nan), [first], linear(x[n:], 1 / n, first)])]

    return run


def tr(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    out = high - low
    out[1:] = np.maximum(out[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    return out


def atr(n: int) -> Callable:
    return lambda high, low, close: rma(n)(tr(high, low, close))


def macd(fast: int, slow: int, signal: int) -> Callable:
    def run(x):
        m = ema(fast)(x)[0] - ema(slow)(x)[0]
        begin = max(fast, slow) - 1
        g = np.full(len(x), np.nan)
        if len(x) > begin >= 0 and signal > 0:
            g[begin:] = ema(signal)(m[begin:])[0]
        return [m, g, m - g]

    return run


def supertrend(factor: float, n: int) -> Callable:
    def run(high, low, close):
        size = len(close)
        line, side = np.full(size, np.nan), np.full(size, np.nan)
        if n <= 0 or not size:
            return [line, side]
        band, mid = factor * _seeded(tr(high, low, close), 1 / n), (high + low) / 2
        ups, downs, closes = (mid + band).tolist(), (mid - band).tolist(), close.tolist()
        upper, lower, before, on_upper = ups[0], downs[0], closes[0], True
        got, sides = [], []
        for u, d, c in zip(ups[1:], downs[1:], closes[1:], strict=True):
            if u < upper or before > upper:
                upper = u
            if d > lower or before < lower:
                lower = d
            on_upper = c <= upper if on_upper else c < lower
            got.append(upper if on_upper else lower)
            sides.append(-1.0 if on_upper else 1.0)
            before = c
        line[1:], side[1:] = got, sides
        return [line, side]

    return run


def dmi(n: int, smooth: int) -> Callable:
    def run(high, low, close):
        size = len(close)
        out = [np.full(size, np.nan) for _ in range(3)]
        if n <= 0 or smooth <= 0 or size < 2:
            return out
        up, down = np.diff(high), -np.diff(low)
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        ranges = tr(high, low, close)
        t = linear(ranges[1:], 1 / n, ranges[0])
        if not (t > 0).all():
            return None
        p, m = 100 * linear(plus, 1 / n, 0.0) / t, 100 * linear(minus, 1 / n, 0.0) / t
        both = p + m
        dx = np.divide(100 * np.abs(p - m), both, out=np.zeros(len(both)), where=both > 0)
        for column, v in zip(out, (p, m, _seeded(dx, 1 / smooth)), strict=True):
            column[1:] = v
        return out

    return run
