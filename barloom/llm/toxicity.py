"""Toxicity by a subsequence string-kernel machine with Nyström landmarks (operator 6).

A text is a bag of tokens. The kernel of two tokens counts their common
subsequences of three characters, each weighed by a decay for every character
that it spans, so gaps and inserted characters lower a match but don't end it;
it is normalized and raised to a power. A text's similarity to a landmark is
that of its best token, so the length of a text doesn't matter. Landmarks are
tokens of labelled texts; similarities pass through the Nyström whitening into
a linear support vector machine with squared hinge loss, whose margin is made a
probability on the texts it was fitted on.

Tokens that share too few ordered character pairs with a landmark have
similarity 0 to it by definition; so only few pairs need the recursion.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy

DECAY, ORDER, POWER, SPAN = 0.6, 3, 2.0, 4
SHARED = 0.45  # of a landmark's character pairs that a token must have
LONGEST, STRIDE = 24, 12
START = "^"  # stands before every token, so that its beginning counts
SURPLUS = 16.0  # least log-likelihood ratio of a landmark
_SEEN = 250_000
_LETTERS = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_EDGE = ".,;:!?\"'()[]{}<>|*&%$#-_=+/\\«»¿¡…“”‘’"


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens; spelled-out letters count as one, long tokens as overlapping parts."""
    text = text.lower()
    raw = set(text.split())
    out = {t.strip(_EDGE) for t in raw}
    for run in _LETTERS.findall(text):
        out.add(re.sub(r"\s", "", run))
    for t in [t for t in out if len(t) > LONGEST]:
        out.discard(t)
        out.update(t[i : i + LONGEST] for i in range(0, len(t), STRIDE))
    return {START + t for t in out if len(t) >= ORDER}


def candidates(bag: set[str]) -> set[str]:
    """What may become a landmark: tokens and their first few characters."""
    return bag.union(t[:n] for t in bag for n in (5, 6, 7) if n < len(t))


def disguised(token: str) -> str:
    """The token with one character put in or doubled, at a place that its text decides."""
    code = zlib.crc32(token.encode())
    at = 2 + code % max(1, len(token) - 2)
    extra = (token[at - 1], ".", "*", "x")[code // 97 % 4]
    return token[:at] + extra + token[at:]


def _surplus(c: int, np_: int, n: int, nn: int) -> float:
    """Log-likelihood ratio of a string in c of np_ toxic and n of nn other texts; 0 if not commoner in the former."""
    if c * nn <= n * np_:
        return 0.0

    def part(k, m):
        return sum(x * np.log(x / m) for x in (k, m - k) if x)

    return 2 * (part(c, np_) + part(n, nn) - part(c + n, np_ + nn))


def _codes(words: list[str]) -> np.ndarray:
    """(words, longest) code points, 0 beyond a word's end."""
    n = max(map(len, words))
    flat = np.array([w.ljust(n, "\0") for w in words], f"<U{n}")
    return flat.view("<u4").reshape(len(words), n)


def _pairs(codes: np.ndarray) -> np.ndarray:
    """A mask of 256 bits (4 words) of the ordered character pairs within SPAN places."""
    out = np.zeros((len(codes), 4), np.uint64)
    c = codes.astype(np.uint64)
    for gap in range(1, SPAN + 1):
        a, b = c[:, :-gap], c[:, gap:]
        h = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)
        bit = np.where((a > 0) & (b > 0), np.uint64(1) << (h & np.uint64(63)), np.uint64(0))
        part = (h >> np.uint64(6)).astype(np.int64)
        for w in range(4):
            out[:, w] |= np.bitwise_or.reduce(np.where(part == w, bit, np.uint64(0)), axis=1)
    return out


def _decays(n: int) -> np.ndarray:
    gap = np.arange(n)[None, :] - np.arange(n)[:, None]
    return np.where(gap > 0, np.float32(DECAY) ** (gap - 1), 0).astype(np.float32)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unnormalized subsequence kernel of equally many rows of code points.

    A subsequence of ORDER characters that spans n places weighs DECAY ** n.
    """
    d = np.float32(DECAY)
    same = ((s[:, :, None] == t[:, None, :]) & (s[:, :, None] > 0)).astype(np.float32) * d * d
    down, across = _decays(s.shape[1]).T.copy(), _decays(t.shape[1])
    part = same
    for _ in range(ORDER - 1):
        part = same * np.matmul(np.matmul(down, part), across)
    return part.sum(axis=(1, 2))


@dataclass
class Model:
    landmarks: list[str]
    codes: np.ndarray = field(init=False)
    masks: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)
    need: np.ndarray = field(init=False)
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.codes = _codes(self.landmarks)
        self.masks = _pairs(self.codes)
        self.own = np.maximum(kernel(self.codes, self.codes), 1e-12)
        count = np.bitwise_count(self.masks).sum(axis=1)
        self.need = np.maximum(3, np.ceil(count * SHARED).astype(int))

    def similar(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, similarity) of the pairs with any."""
        rows, cols = [], []
        codes = [np.empty((0, 1), "<u4")]
        for at in range(0, len(words), 20_000):
            part = _codes(words[at : at + 20_000])
            masks = _pairs(part)
            for j in range(len(self.landmarks)):
                hit = np.flatnonzero(np.bitwise_count(masks & self.masks[j]).sum(axis=1) >= self.need[j])
                rows.append(hit + at)
                cols.append(np.full(len(hit), j))
        rows, cols = (np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, cols))
        if not len(rows):
            return rows, cols, np.empty(0, np.float32)
        used, of = np.unique(rows, return_inverse=True)
        codes = _codes([words[i] for i in used])
        size = (codes > 0).sum(axis=1)
        own, vals = np.empty(len(used), np.float32), np.empty(len(rows), np.float32)
        by = np.argsort(size, kind="stable")
        for at in range(0, len(by), 2048):
            h = by[at : at + 2048]
            c = codes[h, : size[h].max()]
            own[h] = kernel(c, c)
        by = np.argsort(size[of], kind="stable")
        for at in range(0, len(by), 2048):
            h = by[at : at + 2048]
            vals[h] = kernel(codes[of[h], : size[of[h]].max()], self.codes[cols[h]])
        vals = (vals / np.sqrt(np.maximum(own[of] * self.own[cols], 1e-12))) ** POWER
        return rows, cols, vals

    def features(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        return self.bags([tokens(t) if t else set() for t in texts], memo)

    def bags(self, bags: list[set[str]], memo: Memo) -> np.ndarray:
        out = np.zeros((len(bags), len(self.landmarks)), np.float32)
        memo.learn(self, set().union(*bags))
        known = memo.known
        for i, bag in enumerate(bags):
            for w in bag & known.keys():
                cols, vals = known[w]
                np.maximum.at(out[i], cols, vals)
        return out

    def score(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        margin = self.features(texts, memo).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


class Memo:
    """A worker's tokens seen so far: those like a landmark with their similarities."""

    def __init__(self):
        self.seen: set[str] = set()
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def learn(self, model: Model, words: set[str]) -> None:
        if len(self.seen) > _SEEN:
            self.seen.clear()
            self.known.clear()
        new = list(words - self.seen)
        if not new:
            return
        self.seen.update(new)
        rows, cols, vals = model.similar(new)
        by = np.argsort(rows, kind="stable")
        rows, cols, vals = rows[by], cols[by], vals[by]
        cut = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else []
        for a, b in zip(cut, np.append(cut[1:], len(rows)) if len(cut) else [], strict=True):
            self.known[new[rows[a]]] = (cols[a:b], vals[a:b])


def _choose(telling: list[str], count: int) -> list[str]:
    """Landmarks: telling tokens, best first, unless one taken already is much alike."""
    chosen: list[str] = []
    for w in telling:
        if len(chosen) >= count:
            break
        if chosen:
            c = _codes([w, *chosen])
            k = kernel(np.broadcast_to(c[:1], (len(chosen), c.shape[1])), c[1:])
            own = kernel(c, c)
            if (k / np.sqrt(np.maximum(own[0] * own[1:], 1e-12)) > 0.85).any():
                continue
        chosen.append(w)
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 100.0) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine by Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.full(len(x), cost * 100 / len(x))
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        active = sign * (z @ w) < 1
        za, wa = z[active], weight[active]
        step = np.linalg.solve(za.T @ (za * wa[:, None]) + ridge, za.T @ (wa * sign[active]))
        if np.abs(step - w).max() < 1e-8:
            break
        w = step
    return w[:-1], float(w[-1])


def _platt(margin: np.ndarray, y: np.ndarray, toxic: float) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, which a share ``toxic`` of all texts have; by smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, toxic / max(1, pos), (1 - toxic) / max(1, neg)) * len(y)
    a, b = 1.0, 0.0
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        grad = z.T @ (weight * (p - target))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, grad)
        step = step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
    sample: int = 3000, landmarks: int = 64,
) -> Model | None:
    """A model from documents and their labels (id, 0 or 1); None without texts of both labels.

    At most ``sample`` labelled ids of each label are used, the first by a hash
    of the id; so the join that fetches their texts has a bounded side, and the
    fit runs in one task. Equal texts count once; an id that repeats counts with
    its least text.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label in (0, 1)")
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = counts[1] / (counts[0] + counts[1])
    order = F.xxhash64("id", F.lit(6))
    chosen = [labels.where(F.col("label") == v).orderBy(order, "id").limit(sample) for v in (1, 0)]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")

    def run(table: pa.Table) -> pa.Table:
        labels, texts = table.column("label").to_pylist(), table.column("text").to_pylist()
        sides = [sorted({t or "" for t, y in zip(texts, labels, strict=True) if y == v}) for v in (1, 0)]
        return pa.table({"model": pa.array([pickle.dumps(fitted(sides, landmarks, share))], pa.binary())})

    found = rows.groupBy().applyInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else None


def fitted(texts: list[list[str]], landmarks: int, share: float) -> Model | None:
    """A model from toxic and other texts; ``share`` of all labelled texts are toxic."""
    pos, neg = (Counter(w for t in side for w in candidates(tokens(t) if t else set())) for side in texts)
    np_, nn = map(len, texts)
    if not np_ or not nn:
        return None
    rated = {w: _surplus(c, np_, neg[w], nn) for w, c in pos.items() if c > 1 or np_ < 10}
    telling = sorted(rated, key=lambda w: (-rated[w], w))
    chosen = _choose([w for w in telling if rated[w] >= SURPLUS] or telling[:4], landmarks)
    if not chosen:
        return None
    model = Model(chosen)
    memo = Memo()
    toxic = [tokens(t) if t else set() for t in texts[0]]
    every = lambda bags: [model.bags(bags[i : i + 256], memo) for i in range(0, len(bags), 256)]
    x = every(toxic)
    # A toxic text stays toxic with one telling token only, and with that one disguised.
    fewer = []
    for bag in toxic:
        hits = sorted(t for t in bag & memo.known.keys() if memo.known[t][1].max() > 0.7)
        if hits:
            one = hits[zlib.crc32(" ".join(hits).encode()) % len(hits)]
            fewer += [bag.difference(hits) | {t} for t in (one, disguised(one))[: 1 + (zlib.crc32(one.encode()) + len(bag)) % 4 // 3]]
    more = every(fewer)
    y = np.concatenate([np.ones(np_ + len(fewer)), np.zeros(nn)])
    clean = [model.features(texts[1][i : i + 256], memo) for i in range(0, nn, 256)]
    x = np.concatenate([*x, *more, *clean]).astype(np.float64)
    # Nyström: whiten by the kernel matrix of the landmarks.
    c = model.codes
    gram = np.stack([kernel(np.broadcast_to(c[i], c.shape), c) for i in range(len(c))]).astype(np.float64)
    gram = (gram / np.sqrt(np.outer(model.own, model.own))) ** POWER
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    w, bias = _machine(x @ white, y)
    model.weights, model.bias = white @ w, bias
    margin = x @ model.weights + bias
    model.slope, model.shift = _platt(margin, y, share)
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", *, score_col: str = "score") -> DataFrame:
    """The input with ``score_col``: the probability that a text is toxic, 0 to 1.

    Only the text counts. Null and empty texts get the score of a text without
    tokens; without a model every score is 0. An input column called
    ``score_col`` is replaced; an empty input gives an empty result.
    """
    docs = docs.drop(score_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            for piece in slices(batch, 4 << 20, text_col):
                texts = piece.column(text_col).to_pylist()
                found = model.score(texts, memo) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.float64())], [*piece.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
