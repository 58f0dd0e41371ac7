"""Indicators as state machines: one bar in, one value out.

These serve the recursive indicators in batch, the same ones under streaming and
the script interpreter. A machine is made with its lengths, then called with a
bar's values; na is None.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable

Value = float | None


class Ema:
    """Seeded with the first value; na until n bars. An ungated one repeats over na."""

    def __init__(self, n: int, gated: bool = True, alpha: float | None = None):
        self.n, self.gated = n, gated
        self.k = alpha if alpha is not None else 2 / (n + 1) if n > 0 else 0.0
        self.v: Value = None
        self.bars = 0
        self.dead = n <= 0

    def __call__(self, x: Value) -> Value:
        self.bars += 1
        if x is None:
            # An na poisons the gated form for good, as a running state would.
            self.dead |= self.gated
        elif not self.dead:
            self.v = x if self.v is None else x * self.k + self.v * (1 - self.k)
        if self.dead or self.gated and self.bars < self.n:
            return None
        return self.v


class Rma:
    """Wilder's average: the mean of the first n values, then (v * (n - 1) + x) / n."""

    def __init__(self, n: int):
        self.n, self.sum, self.bars, self.v, self.dead = n, 0.0, 0, None, n <= 0

    def __call__(self, x: Value) -> Value:
        self.bars += 1
        self.dead |= x is None
        if self.dead:
            return None
        if self.bars <= self.n:
            self.sum += x
            self.v = self.sum / self.n
        else:
            self.v = (self.v * (self.n - 1) + x) / self.n
        return self.v if self.bars >= self.n else None


class Tr:
    def __init__(self):
        self.close: Value = None

    def __call__(self, high: float, low: float, close: float) -> float:
        c, self.close = self.close, close
        return high - low if c is None else max(high - low, abs(high - c), abs(low - c))


class Atr:
    def __init__(self, n: int):
        self.tr, self.rma = Tr(), Rma(n)

    def __call__(self, high, low, close):
        return self.rma(self.tr(high, low, close))


class Macd:
    def __init__(self, fast: int, slow: int, signal: int):
        self.f, self.s, self.g = Ema(fast), Ema(slow), Ema(signal)

    def __call__(self, x):
        f, s = self.f(x), self.s(x)
        if f is None or s is None:
            return None, None, None
        m = f - s
        g = self.g(m)
        return m, g, None if g is None else m - g


class Kc:
    def __init__(self, n: int, mult: float, use_tr: bool = True):
        self.mid, self.band, self.tr, self.mult, self.use_tr = Ema(n), Ema(n), Tr(), mult, use_tr

    def __call__(self, x, high, low, close):
        r = self.tr(high, low, close)
        mid, band = self.mid(x), self.band(r if self.use_tr else high - low)
        if mid is None or band is None:
            return None, None, None
        return mid, mid + self.mult * band, mid - self.mult * band


class Tsi:
    def __init__(self, short: int, long: int):
        self.last = None
        self.a, self.b = (Ema(short, False), Ema(long, False)), (Ema(short, False), Ema(long, False))

    def __call__(self, x):
        d = None if self.last is None or x is None else x - self.last
        self.last = x
        if d is None:
            return None
        num, den = self.a[1](self.a[0](d)), self.b[1](self.b[0](abs(d)))
        return 100 * num / den if den else None


class Dmi:
    def __init__(self, n: int, smooth: int):
        self.ok = n > 0 and smooth > 0
        self.a, self.b = (1 / n, 1 / smooth) if self.ok else (0.0, 0.0)
        self.bars, self.p, self.m, self.t, self.adx = 0, 0.0, 0.0, 0.0, None
        self.last = None

    def __call__(self, high, low, close):
        if not self.ok:
            return None, None, None
        last, self.last = self.last, (high, low, close)
        self.bars += 1
        if last is None:
            self.t = high - low
            return None, None, None
        up, down = high - last[0], last[1] - low
        tr = max(high - low, abs(high - last[2]), abs(low - last[2]))
        plus = up if up > down and up > 0 else 0.0
        minus = down if down > up and down > 0 else 0.0
        self.p += self.a * (plus - self.p)
        self.m += self.a * (minus - self.m)
        self.t += self.a * (tr - self.t)
        if self.t == 0:
            return None, None, None
        p, m = 100 * self.p / self.t, 100 * self.m / self.t
        dx = 0.0 if p + m == 0 else 100 * abs(p - m) / (p + m)
        self.adx = dx if self.adx is None else self.adx + self.b * (dx - self.adx)
        return p, m, self.adx


class Sar:
    def __init__(self, start: float, step: float, most: float):
        self.start, self.step, self.most = start, step, most
        self.ok = start > 0 and step > 0 and most > 0
        self.bars: list[tuple[float, float]] = []
        self.up = True
        self.sar = self.ep = self.af = 0.0

    def __call__(self, high, low):
        self.bars = [*self.bars[-2:], (high, low)]
        if len(self.bars) == 1 or not self.ok:
            return None
        if len(self.bars) == 2:
            (h0, l0), (h1, _) = self.bars
            self.up = h1 >= h0
            self.sar, self.ep = (l0, h0) if self.up else (h0, l0)
            self.af = self.start
        self.sar += self.af * (self.ep - self.sar)
        before = self.bars[:-1]
        if self.up:
            self.sar = min(self.sar, *(b[1] for b in before)) if before else self.sar
            if low < self.sar:
                self.up, self.sar, self.ep, self.af = False, self.ep, low, self.start
            elif high > self.ep:
                self.ep, self.af = high, min(self.af + self.step, self.most)
        else:
            self.sar = max(self.sar, *(b[0] for b in before)) if before else self.sar
            if high > self.sar:
                self.up, self.sar, self.ep, self.af = True, self.ep, high, self.start
            elif low < self.ep:
                self.ep, self.af = low, min(self.af + self.step, self.most)
        return self.sar


class Supertrend:
    """(line, direction): +1 when price is above the line, -1 below; na on the first bar.

    The average range is seeded with its first value.
    """

    def __init__(self, factor: float, n: int):
        self.ok = n > 0
        self.factor, self.tr, self.atr = factor, Tr(), Ema(n, False, 1 / n if n > 0 else 0.0)
        self.upper = self.lower = self.close = None
        self.on_upper = True

    def __call__(self, high, low, close):
        if not self.ok:
            return None, None
        band = self.factor * self.atr(self.tr(high, low, close))
        mid = (high + low) / 2
        u, d = mid + band, mid - band
        before, self.close = self.close, close
        if before is None:
            self.upper, self.lower = u, d
            return None, None
        self.upper = u if u < self.upper or before > self.upper else self.upper
        self.lower = d if d > self.lower or before < self.lower else self.lower
        self.on_upper = close <= self.upper if self.on_upper else close < self.lower
        return (self.upper, -1.0) if self.on_upper else (self.lower, 1.0)


class Rolling:
    """A function of the last n values, oldest first; na until full or if one is na."""

    def __init__(self, n: int, f: Callable):
        self.held, self.n, self.f = deque(maxlen=max(1, n)), n, f

    def __call__(self, *x):
        self.held.append(x[0] if len(x) == 1 else x)
        if len(self.held) < self.n:
            return None
        for v in self.held:
            if v is None or isinstance(v, tuple) and any(y is None for y in v):
                return None
        return self.f(list(self.held))


class Sums:
    """A function of the running sums of the last n values or pairs, kept bar by bar; na until full or while one is na.

    Sums are of values less a value of the window, and are made anew now and
    then, so that rounding doesn't add up.
    """

    REFRESH = 512

    def __init__(self, n: int, f: Callable):
        self.n, self.f = n, f
        self.held: deque = deque()
        self.gaps = self.age = 0
        self.zero: tuple | None = None
        self.sums = [0.0] * 5

    def __call__(self, *x: Value):
        if self.n <= 0:
            return None
        self.held.append(x)
        self._count(x, 1)
        self.age += 1
        if len(self.held) > self.n:
            old = self.held.popleft()
            self._count(old, -1)
            # What rounding an outlier has left behind outweighs the rest.
            if None not in old and any((v - z) ** 2 > 1e4 * abs(self.sums[2 * i + 1]) for i, (v, z) in enumerate(zip(old, self.zero, strict=True))):
                self.age = self.REFRESH
        if self.age >= self.REFRESH:
            self._renew()
        if len(self.held) < self.n or self.gaps:
            return None
        return self.f(self)

    def _count(self, x: tuple, sign: int) -> None:
        if None in x:
            self.gaps += sign
            return
        if self.zero is None:
            self.zero = x
        s, a = self.sums, x[0] - self.zero[0]
        s[0] += sign * a
        s[1] += sign * a * a
        if len(x) > 1:
            b = x[1] - self.zero[1]
            s[2] += sign * b
            s[3] += sign * b * b
            s[4] += sign * a * b

    def _renew(self) -> None:
        self.age, self.gaps, self.zero, self.sums = 0, 0, None, [0.0] * 5
        for x in self.held:
            self._count(x, 1)

    def mean(self) -> float:
        return self.zero[0] + self.sums[0] / self.n

    def spread(self, i: int = 0) -> float:
        """Sum of squares about the mean; from the values themselves where the sums have cancelled out."""
        total, squares = self.sums[2 * i], self.sums[2 * i + 1]
        out = squares - total * total / self.n
        if out > 1e-7 * squares:
            return out
        v = [x[i] for x in self.held]
        m = mean(v)
        return sum((x - m) ** 2 for x in v)

    def var(self, biased: bool = True) -> Value:
        n = self.n if biased else self.n - 1
        return self.spread() / n if n else None

    def stdev(self, biased: bool = True) -> Value:
        v = self.var(biased)
        return None if v is None else math.sqrt(v)

    def correlation(self) -> Value:
        den = math.sqrt(self.spread(0) * self.spread(1))
        if not den:
            return None
        s = self.sums
        out = s[4] - s[0] * s[2] / self.n
        if abs(out) <= 1e-7 * abs(s[4]):
            return correlation(list(self.held))
        return out / den

    def bands(self, mult: float) -> tuple[float, float, float]:
        m, d = self.mean(), self.stdev()
        return m, m + mult * d, m - mult * d


class Extreme:
    """The largest of the last n values (of the negated ones with sign -1); na until full or while one is na."""

    def __init__(self, n: int, sign: float = 1.0):
        self.n, self.sign, self.bars, self.gap = n, sign, 0, -n
        self.best: deque = deque()  # (bar, value), falling

    def __call__(self, x: Value) -> Value:
        i, self.bars = self.bars, self.bars + 1
        if x is None:
            self.gap = i
        else:
            v = self.sign * x
            while self.best and self.best[-1][1] <= v:
                self.best.pop()
            self.best.append((i, v))
        while self.best and self.best[0][0] <= i - self.n:
            self.best.popleft()
        if self.n <= 0 or i + 1 < self.n or i - self.gap < self.n:
            return None
        return self.sign * self.best[0][1]


class Listed:
    """A machine with several outputs, all na where it gives none."""

    def __init__(self, inner: Callable, n: int):
        self.inner, self.n = inner, n

    def __call__(self, *x):
        out = self.inner(*x)
        return (None,) * self.n if out is None else out


class Lag:
    def __init__(self, n: int):
        self.held = deque(maxlen=n + 1)

    def __call__(self, x):
        self.held.append(x)
        return self.held[0] if len(self.held) == self.held.maxlen else None


class Chain:
    """Windows of windows, for the Hull average."""

    def __init__(self, n: int):
        half, root = max(1, n // 2), max(1, int(math.sqrt(n) + 0.5))
        self.a, self.b, self.c = Rolling(half, wma), Rolling(n, wma), Rolling(root, wma)

    def __call__(self, x):
        a, b = self.a(x), self.b(x)
        return self.c(None if a is None or b is None else 2 * a - b)


def mean(v):
    return sum(v) / len(v)


def wma(v):
    n = len(v)
    return sum((i + 1) * x for i, x in enumerate(v)) / (n * (n + 1) / 2)


def var(v, biased=True):
    m = mean(v)
    n = len(v) if biased else len(v) - 1
    return sum((x - m) ** 2 for x in v) / n if n else None


def stdev(v, biased=True):
    x = var(v, biased)
    return None if x is None else math.sqrt(x)


def correlation(pairs):
    a, b = zip(*pairs, strict=True)
    ma, mb = mean(a), mean(b)
    den = math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    return sum((x - ma) * (y - mb) for x, y in pairs) / den if den else None


def mad(v):
    m = mean(v)
    return sum(abs(x - m) for x in v) / len(v)


def pct_linear(v, p):
    s = sorted(v)
    at = p / 100 * (len(s) - 1)
    lo = min(max(math.floor(at), 0), len(s) - 1)
    hi = min(lo + 1, len(s) - 1)
    return s[lo] + (at - lo) * (s[hi] - s[lo])


def pct_nearest(v, p):
    s = sorted(v)
    return s[min(max(math.ceil(p / 100 * len(s)), 1), len(s)) - 1]


def mode(v):
    c = Counter(v)
    return min(c, key=lambda x: (-c[x], x))


def linreg(v, offset=0):
    n = len(v)
    if n <= 1:
        return None
    mx, my = (n - 1) / 2, mean(v)
    slope = sum((i - mx) * (y - my) for i, y in enumerate(v)) / sum((i - mx) ** 2 for i in range(n))
    return my + slope * (n - 1 - offset - mx)


def moves(v):
    d = [b - a for a, b in zip(v, v[1:], strict=False)]
    return sum(x for x in d if x > 0), sum(-x for x in d if x < 0)


def rsi(v):
    up, down = moves(v)
    return 50.0 if up == down == 0 else 100.0 if down == 0 else 100 - 100 / (1 + up / down)


def cmo(v):
    up, down = moves(v)
    return 100 * (up - down) / (up + down) if up + down else 0.0


def alma(v, offset=0.85, sigma=6.0, floor=False):
    n = len(v)
    m = math.floor(offset * (n - 1)) if floor else offset * (n - 1)
    s = n / sigma
    w = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]
    return sum(a * b for a, b in zip(w, v, strict=True)) / sum(w)


def cci(v):
    d = mad(v)
    return (v[-1] - mean(v)) / (0.015 * d) if d else 0.0


def cog(v):
    return -sum((i + 1) * x for i, x in enumerate(v)) / sum(v) if sum(v) else None


def mfi(pairs):
    pos = neg = 0.0
    for (a, _), (b, vol) in zip(pairs, pairs[1:], strict=False):
        pos, neg = (pos + b * vol, neg) if b > a else (pos, neg + b * vol) if b < a else (pos, neg)
    return 100.0 if neg == 0 else 0.0 if pos == 0 else 100 - 100 / (1 + pos / neg)
