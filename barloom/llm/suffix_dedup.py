"""Removal of byte strings that repeat across documents (operator 10).

A sparse suffix array, sorted in range-partitioned buckets. Every window of
``length`` bytes is anchored at the position of its least k-gram hash, which
depends on the window's bytes alone; equal windows therefore have equal
anchors, and only the suffixes at anchors (about 2 in ``length - k + 2``
positions) need sorting.

1. Documents are packed into blocks, a table bucketed by block in the shared
   folder; later steps meet it without shuffling texts again.
2. Each block sends its anchors' distinct k-gram hashes to hash buckets, which
   answer with a bit for each: does another document have it? It also sends a
   few leading keys of its suffixes, a sample in proportion to the data.
3. Only anchors whose k-gram repeats go on. Sampled splitters range-partition
   their contexts (the bytes of all the windows at an anchor) by their leading
   bytes, each distinct context once for a block with its least document.
4. Buckets sort contexts by multikey quicksort, eight bytes as one key, and where
   one leading key has several contexts, their windows too. Neighbours in that
   order give each window's least document; blocks get back the least document
   of each context and a bit for each window that has a smaller one elsewhere.
5. A leading key that spans several splitters is too common for one bucket: its
   windows are counted by a digest instead, least documents first by task and
   then in all, so that no task depends on one passage.
6. Blocks mark the bytes covered.

Buckets are cut between leading keys, never within one. So suffixes that begin
alike never stand on both sides of a boundary, and comparing neighbouring buckets
can't find anything more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bucket_count, tidy, utf8

U = np.uint64
_BYTE = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64)
_ROOT = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_LAST = np.iinfo(np.int64).max
#: Leading keys that a block adds to the sample, and the most buckets (their splitters travel with the tasks).
SAMPLED, BUCKETS = 32, 1 << 20
#: Groups of at most so many rows are sorted outright.
SMALL = 4096
#: The part of notes about windows of common leading keys.
HOT = -(1 << 31)
_power: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int, root: int) -> np.ndarray:
    """Powers 0 to n - 1 of root; kept for the length of a chunk."""
    if root not in _power or len(_power[root]) < n:
        out = np.full(max(n, _CHUNK + 4096), U(root))
        out[0] = 1
        _power[root] = np.multiply.accumulate(out)
    return _power[root][:n]


class Block:
    """Texts laid end to end, sorted by id."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str):
        self.table = table
        texts = utf8(table.column(text_col))
        self.ids = pc.fill_null(table.column(id_col).cast(pa.int64()), _LAST).to_numpy()
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


class Runs:
    """Maximal runs of consecutive windows with one anchor, in order of position.

    Window p covers bytes p to p + length - 1; ``start`` to ``end`` are the
    first and the last window of a run.
    """

    def __init__(self, block: Block, length: int, k: int):
        data, found = block.data, []
        ok = np.ones(max(0, len(data) - length + 1), bool)
        for lo, hi in zip(block.bounds[:-1], block.bounds[1:], strict=True):
            ok[max(lo, hi - length + 1) : hi] = False
        for at in range(0, len(ok), _CHUNK):
            found.append(self._chunk(data, ok[at : at + _CHUNK], at, length, k))
        names = ("start", "end", "anchor", "gram", "content")
        for i, name in enumerate(names):
            kind = U if i > 2 else np.int64
            setattr(self, name, np.concatenate([np.empty(0, kind), *(f[i] for f in found)]))
        self.doc = np.searchsorted(block.bounds, self.start, side="right") - 1

    @staticmethod
    def _chunk(data, ok, at, length, k):
        piece = data[at : at + len(ok) + length - 1]
        grams, width = len(piece) - k + 1, length - k + 1
        total = np.zeros(len(piece) + 1, U)
        np.cumsum(_BYTE[piece] * _powers(len(piece), _ROOT), out=total[1:])
        inverse = _powers(len(piece), pow(_ROOT, -1, 1 << 64))
        h = _mix((total[k:] - total[:-k]) * inverse[:grams])
        least = (h & U(0xFFFFFFFF00000000)) | np.arange(grams, dtype=U)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(ok)], least[width - span :])
        anchor = (least & U(0xFFFFFFFF)).astype(np.int64)
        new = np.empty(len(ok), bool)
        new[:1] = True
        new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        start = np.flatnonzero(new & ok)
        last = np.ones(len(ok), bool)
        last[:-1] = (anchor[1:] != anchor[:-1]) | ~ok[1:]
        end = np.flatnonzero(last & ok)
        a = anchor[start]
        size = end - start + length
        content = (total[start + size] - total[start]) * inverse[start]
        content = _mix(content + _mix(((a - start) * 65536 + size).astype(U)))
        return start + at, end + at, a + at, h[a], content

    def take(self, rows: np.ndarray) -> None:
        for name in ("start", "end", "anchor", "gram", "content", "doc"):
            setattr(self, name, getattr(self, name)[rows])

    def leading(self, data: np.ndarray, n: int) -> np.ndarray:
        """The first n bytes of each anchor's suffix."""
        flat = data[self.anchor[:, None] + np.arange(n)]
        return np.ascontiguousarray(flat).view(f"S{n}")[:, 0]


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and the number of the group of equal rows at each place of it.

    Multikey quicksort with eight bytes as one key: a group is divided in three by
    a pivot; rows equal to the pivot go on with the next key. Small groups are
    sorted key by key, all at once.
    """
    n = len(rows)
    pad = -rows.shape[1] % 8
    if pad:
        rows = np.concatenate([rows, np.zeros((n, pad), np.uint8)], axis=1)
    words = np.ascontiguousarray(np.ascontiguousarray(rows).view(">u8").T.astype(U))
    order, begins = np.arange(n), np.zeros(n + 1, bool)
    begins[:1] = True
    todo, small = [(0, n, 0)], []
    while todo:
        lo, hi, j = todo.pop()
        if hi - lo < 2 or j == len(words):
            continue
        if hi - lo <= SMALL:
            small.append((lo, hi, j))
            continue
        at = order[lo:hi]
        key = words[j, at]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, more = key < pivot, key > pivot
        order[lo:hi] = np.concatenate([at[less], at[~(less | more)], at[more]])
        a, b = lo + np.count_nonzero(less), hi - np.count_nonzero(more)
        begins[[a, b]] = True
        todo += [(lo, a, j), (a, b, j + 1), (b, hi, j)]
    small.sort()
    live = np.concatenate([np.empty(0, np.int64), *(np.arange(lo, hi) for lo, hi, _ in small)])
    sizes = [hi - lo for lo, hi, _ in small]
    group = np.repeat(np.array([x[0] for x in small], np.int64), sizes)
    depth = np.repeat(np.array([x[2] for x in small], np.int64), sizes)
    while len(live):
        key = words[depth, order[live]]
        by = np.lexsort((key, group))
        order[live], key = order[live][by], key[by]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        begins[live[new]] = True
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        group = np.repeat(live[new], size)
        on = (np.repeat(size, size) > 1) & (depth + 1 < len(words))
        live, group, depth = live[on], group[on], depth[on] + 1
    return order, np.cumsum(begins[:n]) - 1


def _blocks(id_col: str, text_col: str, size: int):
    from pyspark import TaskContext

    def packed(tables: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(tables)
        table = table.take(pc.sort_indices(table, sort_keys=[(id_col, "ascending")], null_placement="at_end"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0

        def row(tables):
            return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([packed(tables)], pa.binary())], ["blk", "rows"])

        held, total = [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
            at = 0
            for i, s in enumerate(sizes):
                if total and total + s > size:
                    held.append(batch.slice(at, i - at))
                    yield row(held)
                    held, total, at, n = [], 0, i, n + 1
                total += int(s)
            held.append(batch.slice(at))
        if sum(len(b) for b in held):
            yield row(held)

    return run


def _opened(table: pa.Table, id_col: str, text_col: str) -> Iterator[tuple[int, Block]]:
    for blk, rows in zip(table.column("blk").to_pylist(), table.column("rows"), strict=True):
        yield blk, Block(pa.ipc.open_stream(rows.as_buffer()).read_all(), id_col, text_col)


def _limits(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], U)


def _distinct(runs: Runs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-grams of a block, and which of them two of its documents have."""
    if not len(runs.gram):
        return np.empty(0, U), np.empty(0, bool)
    by = np.argsort(runs.gram, kind="stable")
    g, d = runs.gram[by], ids[runs.doc[by]]
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[at], np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)


class Job:
    """What all steps share."""

    def __init__(self, id_col, text_col, length, k, buckets):
        self.id_col, self.text_col, self.length, self.k, self.buckets = id_col, text_col, length, k, buckets
        self.lead = min(k, 16)
        self.splitters = np.empty(0, f"S{self.lead}")

    def grams(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blk, block in _opened(pa.table(batch), self.id_col, self.text_col):
                runs = Runs(block, self.length, self.k)
                g, several = _distinct(runs, block.ids)
                cut = np.concatenate(([0], np.searchsorted(g, _limits(self.buckets)), [len(g)]))
                some = np.flatnonzero(np.diff(cut))
                # The sample of leading keys goes along, in buckets of its own.
                runs.take(np.flatnonzero(_mix(runs.content + U(7)) % U(max(1, len(runs.start) // SAMPLED)) == 0))
                lead = b"".join(x.ljust(self.lead, b"\0") for x in runs.leading(block.data, self.lead).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*some, -1 - blk % self.buckets], pa.int32()),
                        pa.array([blk] * (len(some) + 1), pa.int64()),
                        pa.array([*(g[cut[i] : cut[i + 1]].tobytes() for i in some), lead], pa.binary()),
                        pa.array([*(np.packbits(several[cut[i] : cut[i + 1]]).tobytes() for i in some), b""], pa.binary()),
                    ],
                    ["bucket", "blk", "grams", "several"],
                )

    def repeated(self, table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            least = pa.array([None] * len(table), pa.binary())
            return pa.table({"blk": table.column("blk"), "part": table.column("bucket"), "least": least, "bits": table.column("grams")})
        grams = [np.frombuffer(x, U) for x in table.column("grams").to_pylist()]
        several = [
            np.unpackbits(np.frombuffer(x, np.uint8), count=len(g)).astype(bool)
            for x, g in zip(table.column("several").to_pylist(), grams, strict=True)
        ]
        g, s = np.concatenate(grams), np.concatenate(several)
        by = np.argsort(g)
        h = g[by]
        same = h[1:] == h[:-1]
        hit = np.zeros(len(g), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out = np.empty(len(g), bool)
        out[by] = hit
        out |= s
        ends = np.cumsum([0, *map(len, grams)])
        return pa.table(
            {
                "blk": table.column("blk"),
                "part": table.column("bucket"),
                "least": pa.array([None] * len(grams), pa.binary()),
                "bits": pa.array([np.packbits(out[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
            }
        )

    def leads(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = b"".join(batch.column("bits").to_pylist())
            keys = [keys[i : i + self.lead] for i in range(0, len(keys), self.lead)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["lead"])

    def contexts(self, block: Block, bits: dict[int, bytes]) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs at repeated k-grams; of distinct contexts, the first run and the part; the context of each run.

        Runs whose leading key spans several splitters come last, as the first
        places of their single windows.
        """
        runs = Runs(block, self.length, self.k)
        g, _ = _distinct(runs, block.ids)
        cut = np.concatenate(([0], np.searchsorted(g, _limits(self.buckets)), [len(g)]))
        flags = np.zeros(len(g), bool)
        for i, packed in bits.items():
            n = cut[i + 1] - cut[i]
            flags[cut[i] : cut[i + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
        if len(g):
            runs.take(np.flatnonzero(flags[np.searchsorted(g, runs.gram)]))
        lead = runs.leading(block.data, self.lead)
        lo, hi = (np.searchsorted(self.splitters, lead, side=s) for s in ("left", "right"))
        hot = np.flatnonzero(hi - lo > 1)
        reps = runs.end[hot] - runs.start[hot] + 1
        windows = np.repeat(runs.start[hot], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        cold = np.flatnonzero(hi - lo <= 1)
        runs.take(cold)
        hi = hi[cold]
        _, first, which = np.unique(runs.content, return_index=True, return_inverse=True)
        part = hi[first]
        by = np.argsort(part, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return runs, first[by], part[by], rank[which], windows

    def digests(self, block: Block, windows: np.ndarray) -> np.ndarray:
        data, n = memoryview(block.data), self.length
        made = b"".join(hashlib.blake2b(data[s : s + n], digest_size=16).digest() for s in windows.tolist())
        return np.frombuffer(made, "V16")

    def common(self, blocks: pa.Table, notes: pa.Table) -> pa.Table:
        """Of a block's windows under common leading keys, the distinct ones with their least document."""
        bits = dict(zip(notes.column("part").to_pylist(), notes.column("bits").to_pylist(), strict=True))
        out = {"blk": [], "digest": [], "least": []}
        for blk, block in _opened(blocks, self.id_col, self.text_col):
            *_, windows = self.contexts(block, bits)
            if not len(windows):
                continue
            doc = block.ids[np.searchsorted(block.bounds, windows, side="right") - 1]
            digest, of = np.unique(self.digests(block, windows).view("S16"), return_inverse=True)
            least = np.full(len(digest), _LAST)
            np.minimum.at(least, of, doc)
            out["blk"] += [blk] * len(digest)
            out["digest"] += [x.ljust(16, b"\0") for x in digest.tolist()]
            out["least"] += least.tolist()
        return pa.table({"blk": pa.array(out["blk"], pa.int64()), "digest": pa.array(out["digest"], pa.binary()), "least": pa.array(out["least"], pa.int64())})

    def send(self, blocks: pa.Table, notes: pa.Table) -> pa.Table:
        bits = dict(zip(notes.column("part").to_pylist(), notes.column("bits").to_pylist(), strict=True))
        out = {"part": [], "blk": [], "size": [], "off": [], "least": [], "text": []}
        for blk, block in _opened(blocks, self.id_col, self.text_col):
            runs, first, part, *_ = self.contexts(block, bits)
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows = first[a:b]
                start, end = runs.start[rows], runs.end[rows] + self.length
                out["part"].append(int(part[a]))
                out["blk"].append(blk)
                out["size"].append((end - start).astype(np.int32).tobytes())
                out["off"].append((runs.anchor[rows] - start).astype(np.int32).tobytes())
                out["least"].append(block.ids[runs.doc[rows]].astype(np.int64).tobytes())
                out["text"].append(b"".join(block.data[s:e].tobytes() for s, e in zip(start, end, strict=True)))
        kinds = {"part": pa.int32(), "blk": pa.int64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    def compare(self, table: pa.Table) -> pa.Table:
        """Neighbours in suffix order: the least document of each context and of each of its windows."""
        cat = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        size, off, least = (cat("size", np.int32).astype(np.int64), cat("off", np.int32).astype(np.int64), cat("least", np.int64))
        text = np.concatenate([cat("text", np.uint8), np.zeros(1, np.uint8)])
        begin = np.cumsum(size) - size
        length, width = self.length, self.length - self.k + 1
        col = np.arange(length)
        right = np.where(col < (size - off)[:, None], begin[:, None] + off[:, None] + col, len(text) - 1)
        back = np.arange(1, width)
        left = np.where(back <= off[:, None], begin[:, None] + off[:, None] - back, len(text) - 1)
        tail = np.stack([size >> 8, size & 255, off >> 8, off & 255], axis=1).astype(np.uint8)
        rows = np.concatenate([text[right], text[left], tail], axis=1)
        order, group = multikey_sort(rows)
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        first = order[at]  # one context of each group
        lowest = np.minimum.reduceat(least[order], at)
        masks = np.zeros((len(at), -(-width // 8)), np.uint8)
        lead = rows[first, : self.k]
        same = (lead[1:] == lead[:-1]).all(axis=1)
        mixed = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if len(mixed):
            count = size[first[mixed]] - length + 1
            ctx = np.repeat(mixed, count)
            shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            where = begin[first[ctx]] + shift
            place = off[first[ctx]] - shift
            windows = np.concatenate([text[where[:, None] + col], np.stack([place >> 8, place & 255], axis=1).astype(np.uint8)], axis=1)
            w_order, w_group = multikey_sort(windows)
            w_at = np.flatnonzero(np.concatenate(([True], w_group[1:] != w_group[:-1])))
            low = np.empty(len(ctx), np.int64)
            low[w_order] = np.minimum.reduceat(lowest[ctx[w_order]], w_at)[w_group]
            bit = np.zeros((len(at), width), np.uint8)
            bit[ctx, shift] = low < lowest[ctx]
            masks = np.packbits(bit, axis=1)
        of = np.empty(len(size), np.int64)
        of[order] = group
        ends = np.cumsum([0, *(len(x) // 4 for x in table.column("size").to_pylist())])
        cuts = list(zip(ends[:-1], ends[1:], strict=True))
        return pa.table(
            {
                "blk": table.column("blk"),
                "part": pa.array([-1 - p for p in table.column("part").to_pylist()], pa.int32()),
                "least": pa.array([lowest[of[a:b]].tobytes() for a, b in cuts], pa.binary()),
                "bits": pa.array([masks[of[a:b]].tobytes() for a, b in cuts], pa.binary()),
            }
        )

    def cover(self, schema: pa.Schema):
        width = self.length - self.k + 1

        def run(blocks: pa.Table, notes: pa.Table) -> pa.Table:
            asked, answers, lower = {}, {}, {}
            for part, least, bits in zip(*(notes.column(c).to_pylist() for c in ("part", "least", "bits")), strict=True):
                if part == HOT:
                    lower[bits] = int.from_bytes(least, "big")
                elif part >= 0:
                    asked[part] = bits
                else:
                    answers[-1 - part] = (np.frombuffer(least, np.int64), np.frombuffer(bits, np.uint8).reshape(-1, -(-width // 8)))
            out = []
            for _, block in _opened(blocks, self.id_col, self.text_col):
                edge = np.zeros(len(block.data) + 1, np.int32)
                runs, _, _, which, windows = self.contexts(block, asked)
                if answers:
                    lowest = np.concatenate([answers[p][0] for p in sorted(answers)])[which]
                    masks = np.concatenate([answers[p][1] for p in sorted(answers)])[which]
                    doc = block.ids[runs.doc]
                    whole = doc > lowest
                    np.add.at(edge, runs.start[whole], 1)
                    np.add.at(edge, runs.end[whole] + self.length, -1)
                    rest = np.flatnonzero(~whole & masks.any(axis=1))
                    i, shift = np.nonzero(np.unpackbits(masks[rest], axis=1, count=width))
                    np.add.at(edge, runs.start[rest[i]] + shift, 1)
                    np.add.at(edge, runs.start[rest[i]] + shift + self.length, -1)
                if lower:
                    doc = block.ids[np.searchsorted(block.bounds, windows, side="right") - 1]
                    low = np.array([lower.get(x, _LAST) for x in map(bytes, self.digests(block, windows).tolist())], np.int64)
                    later = windows[doc > low]
                    np.add.at(edge, later, 1)
                    np.add.at(edge, later + self.length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans, kept = [], []
                for lo, hi in zip(block.bounds[:-1], block.bounds[1:], strict=True):
                    m = gone[lo:hi]
                    flip = np.flatnonzero(np.diff(np.concatenate(([False], m, [False])).view(np.int8)))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(flip[::2], flip[1::2], strict=True)])
                    kept.append(block.data[lo:hi][~m].tobytes())
                table = block.table.append_column("spans", pa.array(spans, schema.field("spans").type))
                out.append(table.append_column("kept", pa.array(kept, pa.binary())).cast(schema))
            return pa.concat_tables(out) if out else schema.empty_table()

        return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    length: int = 50,
    block_bytes: int = 2 << 20,
    bucket_rows: int = 1 << 20,
) -> DataFrame:
    """The input's columns, ``spans`` (start, end bytes removed) and ``kept`` (the bytes that remain).

    A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller id. Null texts are empty; texts shorter than
    ``length`` keep all. A null id counts as larger than every id, so such a row
    loses what any other document has and takes nothing from rows like itself.
    Rows with one id take nothing from each other. An empty input gives an empty
    result. Columns of the input named spans or kept are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    docs = docs.drop("spans", "kept")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    k = max(1, length // 3)
    count = bucket_count(spark, total, block_bytes)
    anchors = 2 * total // (length - k + 2) + 1
    job = Job(id_col, text_col, length, k, max(1, -(-anchors // bucket_rows)))
    blocks = scratch.save_bucketed(docs.mapInArrow(_blocks(id_col, text_col, block_bytes), "blk long, rows binary"), count, "blk")
    note = "blk long, part int, least binary, bits binary"
    grams = blocks.mapInArrow(tidy(job.grams), "bucket int, blk long, grams binary, several binary")
    told = scratch.save(grams.groupBy("bucket").applyInArrow(lambda t: job.repeated(t), note))
    job.splitters = _splitters(told.where("part < 0").select("bits").mapInArrow(tidy(job.leads), "lead binary"), job, min(BUCKETS, total // block_bytes), scratch)
    asked = told.where("part >= 0")
    sent = (
        blocks.groupBy("blk")
        .cogroup(asked.groupBy("blk"))
        .applyInArrow(lambda a, b: job.send(a, b), "part int, blk long, size binary, off binary, least binary, text binary")
    )
    answers = scratch.save(sent.groupBy("part").applyInArrow(lambda t: job.compare(t), note))
    notes = asked.unionByName(answers)
    if (job.splitters[1:] == job.splitters[:-1]).any():
        hot = blocks.groupBy("blk").cogroup(asked.groupBy("blk")).applyInArrow(lambda a, b: job.common(a, b), "blk long, digest binary, least long")
        hot = scratch.save(hot)
        lowest = hot.groupBy("digest").agg(F.min("least").alias("m"))
        # A block is told only of windows that a smaller document elsewhere has, or that two of its own have.
        hot = hot.join(lowest, "digest").select("blk", F.lit(HOT).alias("part"), F.unhex(F.lpad(F.hex("m"), 16, "0")).alias("least"), F.col("digest").alias("bits"))
        notes = notes.unionByName(scratch.save(hot))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", spans), T.StructField("kept", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = (
        blocks.groupBy("blk")
        .cogroup(notes.groupBy("blk"))
        .applyInArrow(job.cover(to_arrow_schema(schema)), schema)
    )
    return out


def _splitters(leads: DataFrame, job: Job, parts: int, scratch: Scratch) -> np.ndarray:
    """Leading keys that cut the sample into ``parts`` of equal size; a common key comes several times.

    The sample is sorted in ranges; the driver gets the splitters alone and a
    count for each range.
    """
    if parts < 2:
        return np.empty(0, f"S{job.lead}")
    ranges = leads.repartitionByRange(max(1, parts // 1024 + 1), "lead").sortWithinPartitions("lead")
    number = F.monotonically_increasing_id()
    ranges = scratch.save(ranges.select("lead", F.shiftright(number, 33).alias("range"), number.bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = sorted((r.range, r["count"]) for r in ranges.groupBy("range").count().collect())
    total = sum(n for _, n in sizes)
    if not total:
        return np.empty(0, f"S{job.lead}")
    ends = np.cumsum([n for _, n in sizes])
    before = ranges.sparkSession.createDataFrame([(r, int(e - n)) for (r, n), e in zip(sizes, ends, strict=True)], "range long, before long")
    place = F.col("before") + F.col("at")
    # The i-th splitter stands at place i * total / parts.
    cut = F.floor((place * parts + parts - 1) / total) != F.floor((place * parts - 1) / total)
    found = ranges.join(F.broadcast(before), "range").where(cut & (place > 0))
    found = found.select("lead", place.alias("place")).collect()
    return np.array([bytes(r.lead) for r in sorted(found, key=lambda r: r.place)], f"S{job.lead}")


_BLANK = frozenset(b" \t\n\v\f\r")


def whole_words(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a run of bytes that consists of whole words."""
    if start and data[start - 1] not in _BLANK:
        while start < end and data[start] not in _BLANK:
            start += 1
    if end < len(data) and data[end] not in _BLANK:
        while end > start and data[end - 1] not in _BLANK:
            end -= 1
    return start, end


def cut_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 150, words: int = 50
) -> DataFrame:
    """The input's columns, the text without passages that a document with a smaller id has.

    Runs of bytes that ``remove_repeats`` finds are narrowed to whole words and
    cut if they have ``words`` or more; so texts stay valid, and shorter repeats
    stay whole. Null texts stay null.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, spans in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                at, kept = 0, []
                for s in spans or ():
                    start, end = whole_words(data, s["start"], s["end"])
                    if len(data[start:end].split()) >= words:
                        kept.append(data[at:start])
                        at = end
                texts.append(None if data is None else b"".join([*kept, data[at:]]))
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            names = [n for n in batch.schema.names if n != "spans"]
            yield pa.RecordBatch.from_arrays([texts if n == text_col else batch.column(n) for n in names], names)

    found = remove_repeats(docs, id_col, text_col, length=length).drop("kept")
    return found.mapInArrow(run, docs.schema)
