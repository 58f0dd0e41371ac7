"""Token counts by heap-and-linked-list byte-pair merging (operator 3).

A word's count is its initial symbols less the merges done; no identifiers are
made. Words never meet across white space, so counts are kept by white-space
piece in a bounded cache of the worker.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_model, slices, tidy

_CACHE = 250_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordBpe:
    """Counts as the tokenizers library gives them for a word-level byte-pair file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.symbols = [ids[c] for c in _byte_symbols()]
        self.last = [ids[c + self.suffix] for c in _byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(split)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.starts = tuple({t[:2] for t in special})
        self.space = regex.compile(r"\p{White_Space}+")
        self.cache: dict[str, int] = {}

    def word(self, data: bytes) -> int:
        """Symbols left when no adjacent pair has a rank: pop the lowest, leftmost first."""
        n = len(data)
        sym = [self.symbols[b] for b in data[:-1]] + [self.last[data[-1]]]
        if n == 1:
            return 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            if m := merges.get((sym[i], sym[i + 1])):
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if m := merges.get((new, sym[k])):
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return count

    def piece(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower case goes by single characters, so a capital sigma never becomes a final one.
        text = text.replace("Σ", "σ").lower()
        return sum(self.word(w.encode()) for w in self.words.findall(text))

    def _plain(self, text: str) -> int:
        cache = self.cache
        # str.split also cuts at the separators 1C to 1F, which are no white space here.
        pieces = text.split() if not regex.search("[\x1c-\x1f]", text) else self.space.split(text)
        total = 0
        try:
            return sum(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        for p in pieces:
            n = cache.get(p)
            if n is None:
                n = self.piece(p)
                if len(p) <= 64:
                    if len(cache) >= _CACHE:
                        cache.clear()
                    cache[p] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is not None and any(s in text for s in self.starts):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 2048
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row for each input row.

    ``path`` names a tokenizers file of the word-level byte-pair kind, present
    on every executor. Null and empty texts have no tokens. Strings of special
    tokens inside a text count one each, as the library does by default. An
    empty input gives an empty result; further columns are ignored.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held_model((WordBpe, path), lambda: WordBpe(path))
        for batch in batches:
            for piece in slices(batch):
                counts = [bpe.count(t) if t else 0 for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("n_bytes"), pa.array(counts, pa.int64())],
                    ["id", "n_bytes", "n_tokens"],
                )

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
