"""SentencePiece encoding and decoding by shared-prefix Viterbi (operator 5).

White space is marked, the marked text is cut into words, and the distinct words
of a batch are sorted, which makes them a trie walked depth-first: a word keeps
the forward states of the prefix it shares with the word before it, and only
the rest of it is scored.

For a unigram model the forward score is the best sum of piece scores. For a
BPE model such sums don't give the library's pieces. There the score of a
transition is 0 if two pieces are stable neighbours, that is if merging their
joined text gives just these two, and minus infinity otherwise; exactly one
path stays finite, and it is the one that merging the whole word ends in.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held_model, slices, tidy

MARK, BARE = "▁", "\0"
#: Bytes of known words, and number of known neighbours, that a worker keeps at most.
CACHE_BYTES, CACHE_PAIRS = 48 << 20, 240_000
#: Bytes of text that are encoded at once; longer texts go in parts.
PART = 1 << 20
START, ALONE = 1 << 30, (1 << 30) + 1  # stand for no piece: a word's start, a character without a piece
_NONE = float("-inf")


def _proto(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with identity normalization are read")
    return model


class Recent:
    """Values by key, the recently used kept: two generations of ``limit`` / 2 each.

    ``young`` may be read directly. A key of the old generation that is asked
    for moves to the young one; a full young generation becomes the old one.
    """

    def __init__(self, limit: int):
        self.half = limit // 2
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def put(self, key, value, size: int = 1) -> None:
        self.young[key] = value
        self.size += size

    def turn(self) -> None:
        """Makes room if the young generation is full."""
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0


class Surfaces:
    """What decoding needs of a model file: the bytes of each piece."""

    def __init__(self, path: str):
        model = _proto(path)
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.surface: list[bytes] = []
        for p in model.pieces:
            if p.type == 6:
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == 1:
                self.surface.append(p.piece.replace(MARK, " ").encode())
            else:
                self.surface.append(model.trainer_spec.unk_surface.encode() if p.type == 2 else b"")

    def decode(self, ids: np.ndarray) -> bytes:
        data = b"".join(b"".join(map(self.surface.__getitem__, ids[i : i + 65_536].tolist())) for i in range(0, len(ids), 65_536))
        return data[1:] if self.prefix and data[:1] == b" " else data


class Pieces:
    """A SentencePiece model file with identity normalization."""

    def __init__(self, path: str):
        model = _proto(path)
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.bpe = model.trainer_spec.model_type == 2
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: list[int] = [0] * 256
        self.unknown = model.trainer_spec.unk_id
        self.fallback = model.trainer_spec.byte_fallback
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
            elif p.type == 1:
                self.id[p.piece], self.score[p.piece] = i, p.score
        self.longest = max(map(len, self.id))
        self.lowest = min(self.score.values()) - 10
        self.words = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cut = regex.compile(f"(?<=[^{MARK}]){MARK}")
        self.text = {i: p for p, i in self.id.items()}
        self.backward = self._trie() if self.bpe else {}
        self.stable = Recent(CACHE_PAIRS)
        self.cache = Recent(CACHE_BYTES)

    def merged(self, text: str) -> list[str]:
        """Merging by best score, leftmost first: for short texts, to judge neighbours."""
        parts = list(text)
        while len(parts) > 1:
            best, at = _NONE, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], _NONE)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the joined text of pieces a and b gives just these (a at START or ALONE: just b)."""
        key = a << 32 | b
        known = self.stable.young.get(key)
        if known is None:
            known = self.stable.old.get(key)
            if known is None:
                right = self.text[b]
                left = [self.text[a]] if a < START else []
                known = self.merged("".join((*left, right))) == [*left, right]
            self.stable.put(key, known)
        return known

    def _trie(self) -> dict:
        """Pieces by their characters from the last to the first; the empty key holds a piece's identifier."""
        root: dict = {}
        for piece, i in self.id.items():
            node = root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i
        return root

    def _stable_step(self, word: str, i: int, last: array, start: array) -> None:
        """Extends the stable path to i: every prefix has one; a character that no piece covers stands alone."""
        node, j, stable = self.backward, i, self.stable.young
        while j:
            j -= 1
            node = node.get(word[j])
            if node is None:
                break
            t = node.get("")
            if t is not None and j < i - 1:
                ok = stable.get(last[j] << 32 | t)
                if ok or ok is None and self.neighbours(last[j], t):
                    last.append(t)
                    start.append(j)
                    return
        last.append(self.id.get(word[i - 1], ALONE))
        start.append(i - 1)

    def _best_step(self, word: str, i: int, best: array, start: array) -> None:
        """Extends the best path to i by the piece with the greatest sum of scores."""
        top, at = _NONE, i - 1
        for j in range(max(0, i - self.longest), i):
            s = best[j] + self.score.get(word[j:i], self.lowest if j == i - 1 else _NONE)
            if s > top:
                top, at = s, j
        best.append(top)
        start.append(at)

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Identifiers of each word; the words are taken in sorted order and share the states of common prefixes."""
        out, before, start = {}, "", [0]
        state, step = ([START], self._stable_step) if self.bpe else ([0.0], self._best_step)
        if max(map(len, words), default=0) > 1 << 16:  # a long word's states take their plain bytes
            state, start = array("i" if self.bpe else "d", state), array("i", start)
        for word in sorted(words):
            self.stable.turn()
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del state[same + 1 :], start[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                step(word, i, state, start)
            path, i = [], len(word)
            while i:
                j = start[i]
                t = state[i] if self.bpe else self.id.get(word[j:i], ALONE)
                path += (t,) if t < START else self._missing(word[j:i])
                i = j
            path.reverse()
            out[word] = path
            before = word
        return out

    def _missing(self, text: str) -> list[int]:
        """Identifiers, last first, of a character that has no piece: its bytes, or the unknown piece."""
        return [self.byte[b] for b in reversed(text.encode())] if self.fallback else [self.unknown]

    def marked(self, text: str) -> list[str]:
        """The words of a text. A word with one marker goes without it; others keep theirs, an unmarked one gets BARE."""
        if not text:
            return []
        if self.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [self._plain(w) for w in self.words.findall(self._mark(text))]

    def parts(self, text: str) -> Iterator[list[str]]:
        """The words of a long text, part by part; parts end before a marker that follows another character."""
        text, at = self._mark(text) if text else "", 0
        while at < len(text):
            cut = self.cut.search(text, at + PART)
            end = cut.start() if cut else len(text)
            yield [self._plain(w) for w in self.words.findall(text, at, end)]
            at = end

    def _mark(self, text: str) -> str:
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    @staticmethod
    def _plain(word: str) -> str:
        return word[1:] if word[:1] == MARK and word[1:2] not in ("", MARK) else word if word[0] == MARK else BARE + word

    @staticmethod
    def _whole(word: str) -> str:
        return word if word[0] == MARK else word[1:] if word[0] == BARE else MARK + word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The identifiers of each text, as little-endian int32."""
        if sum(map(len, texts)) <= 2 * PART:
            return self._encoded([self.marked(t) for t in texts])
        return [b"".join(self._encoded([words])[0] for words in self.parts(t)) for t in texts]

    def _encoded(self, split: list[list[str]]) -> list[bytes]:
        self.cache.turn()
        cache = self.cache.young
        missing = set().union(*split).difference(cache)
        for word in missing & self.cache.old.keys():
            self._keep(word, self.cache.old[word])
        new = {self._whole(w): w for w in missing.difference(cache)}
        for word, ids in self.encode_words(list(new)).items():
            self._keep(new[word], struct.pack(f"<{len(ids)}i", *ids))
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for word in new.values():
            if len(word) > 64:
                self._keep(word, b"", -1)
                del cache[word]
        return out

    def _keep(self, word: str, ids: bytes, sign: int = 1) -> None:
        """Enters a word with about the bytes that it takes: two objects and a place in the table."""
        self.cache.put(word, ids, sign * (200 + 2 * len(word) + 4 * len(word)))


def encode(
    docs: DataFrame, path: str, text_col: str = "text", *, ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """The input with the identifiers of each whole text as ``ids_col`` (array of int).

    With ``decoded_col`` also the text that the identifiers decode to, made in
    the same worker. Null and empty texts have no identifiers. The library's
    marker character in a text counts as a space, as in the library. Input
    columns with the names of results are replaced; equal rows get equal
    results; an empty input gives an empty result.
    """
    docs = docs.drop(ids_col, *([decoded_col] if decoded_col else []))
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col:
        new.append(T.StructField(decoded_col, T.StringType()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, back = held_model((Pieces, path, decoded_col), lambda: (Pieces(path), Surfaces(path) if decoded_col else None))
        for batch in batches:
            for piece in slices(batch, PART, text_col):
                found = model.encode([t or "" for t in piece.column(text_col).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                made = [ids]
                if back is not None:
                    texts = (back.decode(np.frombuffer(x, "<i4")).decode("utf-8", "replace") for x in found)
                    made.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], [*piece.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", *, text_col: str = "decoded") -> DataFrame:
    """The input with the text of each list of identifiers as ``text_col``.

    Bytes that aren't UTF-8 are replaced. A null or empty list gives an empty
    text; equal rows get equal texts. An input column called ``text_col`` is
    replaced; an empty input gives an empty result.
    """
    docs = docs.drop(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held_model((Surfaces, path), lambda: Surfaces(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                lists = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32) for x in piece.column(ids_col))
                texts = pa.array([model.decode(x).decode("utf-8", "replace") for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*piece.columns, texts], [*piece.schema.names, text_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())]))
