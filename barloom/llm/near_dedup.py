"""MinHash near-dedup by a multi-index Hamming join (operator 8).

Every document's set of word shingles gets a signature of ``chunks * width``
symbols of 16 bits (the smallest hash under that many permutations). The
signature is split into ``chunks`` chunks. If two signatures differ in fewer
than ``2 * chunks`` symbols, the pigeonhole principle gives a chunk in which
they differ in one symbol at most; so each chunk is entered into the index once
for each symbol left out, and every pair under that distance meets under some
key. Pairs that meet are confirmed on their full sets.

Sets, not documents, are the nodes: equal sets (by a hash of 128 bits) share one
node, so copies cost no index entries.

1. Documents are packed into blocks, a table bucketed by block in the shared
   folder, with their sets' keys; later steps meet it without shuffling texts.
2. Each block sends the packed keys of the sets that it owns to hash buckets,
   which answer how many nodes have each key. Only sets with a key that another
   node has go on, with signature and shingles, into a table bucketed by node.
3. Within a key no pairs are enumerated: the most central nodes act as pivots,
   every member is held against them, and what one component already joins is
   not compared again. Of keys with the same members one stays. First each node
   meets the pivot of its most crowded key, its reference; then pivots take the
   other keys. Pivots whose pairs are all settled leave the key, and the number
   of pivots for a key grows geometrically until nothing unsettled is left, so
   no candidate is ever dropped. Nodes outside a key's largest component are
   pivots first, and a key with no more of them than pivots is settled at once:
   only pairs of different components are open. Members of large groups are
   held against the group's core: that links most of them without comparing
   them with one another, and tells which of the others can be linked at all
   (see ``_cored`` and ``_referred``).
4. Pairs whose signatures are over the distance are far below the threshold;
   the full sets of the others are compared: a pivot's set travels to the node,
   whose own stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucket_count, connected_components, slices, tidy, utf8

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ROOT = 0x9E3779B97F4A7C15
_MOD = 1 << 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int, root: int) -> np.ndarray:
    out = np.ones(max(n, 1), U)
    out[1:] = U(root)
    return np.multiply.accumulate(out)


#: Bytes of a long text whose words are hashed at once.
CHUNK = 1 << 18


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of a buffer."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    # Hash of a word: sum of byte values times powers of an odd root, shifted to position 0.
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _powers(len(data), _ROOT), out=total[1:])
    inverse = _powers(len(data), pow(_ROOT, -1, _MOD))
    return start, _mix((total[end] - total[start]) * inverse[start])


def _long_words(text: bytes) -> np.ndarray:
    """Hashes of a long text's words, taken in chunks that end at white space."""
    data, at, out = np.frombuffer(text, np.uint8), 0, []
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not (gap := np.flatnonzero(_SPACE[data[end : end + CHUNK]])).size:
            end += CHUNK
        end = min(len(data), end + int(gap[0])) if end < len(data) else len(data)
        out.append(_words(data[at:end])[1])
        at = end
    return np.concatenate([np.empty(0, U), *out])


def _shingles(w: np.ndarray, size: int) -> np.ndarray:
    if not len(w):
        return np.empty(0, U)
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, U)
    for j in range(k):
        h = _mix(h * U(0x9DDFEA08EB382D69) + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty without words."""
    if not texts:
        return []
    short = [t if len(t) <= CHUNK else b"" for t in texts]
    data = np.frombuffer(b" ".join(short) + b" ", np.uint8)
    lengths = np.fromiter(map(len, short), np.int64, len(short)) + 1
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    start, words = _words(data)
    cut = np.searchsorted(start, np.append(first, len(data)))
    parts = zip(texts, cut[:-1], cut[1:], strict=True)
    return [_shingles(words[lo:hi] if len(t) <= CHUNK else _long_words(t), size) for t, lo, hi in parts]


class Index:
    """Signatures and index keys."""

    def __init__(self, chunks: int, width: int):
        self.chunks, self.width = chunks, width
        rng = np.random.default_rng(8)
        self.factors = rng.integers(0, 2**63, chunks * width, dtype=np.uint64) * U(2) + U(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.empty(len(self.factors), U)
        step = max(1, (1 << 18) // len(shingles))
        for i in range(0, len(least), step):
            least[i : i + step] = (shingles[None, :] * self.factors[i : i + step, None]).min(axis=1)
        return _mix(least) >> U(48)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, chunks * width) keys: each chunk without one of its symbols."""
        s = signatures.reshape(-1, self.chunks, self.width)
        out = np.empty(s.shape, U)
        for skip in range(self.width):
            h = np.arange(self.chunks, dtype=U)[None, :] * U(self.width) + U(skip)
            for j in range(self.width):
                if j != skip:
                    h = _mix(h * U(0x9DDFEA08EB382D69) + s[:, :, j])
            out[:, :, skip] = h
        return out.reshape(len(s), self.chunks * self.width)


#: Bits of a block's number in its task, and of a set's number in its block; a node is named by its place.
SEQ, PLACE = 16, 21
READ = (
    "blk long, members array<struct<id:long,n:long,hash:binary,place:long,mark:long>>, "
    "lens binary, texts binary, signs binary"
)
CHOSEN = "node long, n long, central long, keys array<long>, sign array<int>, shingles array<long>"
#: Nodes of keys with more members get a reference.
CROWD = 16
#: Of the table of chosen sets, unless it is large.
MOST_BUCKETS = 1 << 12
_MEMBER = pa.struct([("id", pa.int64()), ("n", pa.int64()), ("hash", pa.binary()), ("place", pa.int64()), ("mark", pa.int64())])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, U), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


class _Block:
    """Documents gathered for one row of the block table."""

    def __init__(self, blk: int):
        self.blk, self.size = blk, 0
        self.columns: list[list] = [[] for _ in range(5)]
        self.places: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.signs: list[np.ndarray] = []

    def add(self, piece: pa.RecordBatch, size: int, index: Index) -> None:
        texts = utf8(piece.column("text"))
        sets = shingle_sets(texts, size)
        ids, fresh = piece.column("id").to_pylist(), []
        for i, t, s, m in zip(ids, texts, sets, piece.column("mark").to_pylist(), strict=True):
            name = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            place = None
            # Rows without an id take no part, so a set's place goes to those that have one.
            if name is not None and i is not None:
                place = self.places.setdefault(name, len(self.places))
                if place == len(self.texts):
                    self.texts.append(t)
                    fresh.append(s)
                place |= self.blk << PLACE
            for column, v in zip(self.columns, (i, len(s), name, place, m), strict=True):
                column.append(v)
            self.size += len(t) + 64
        if fresh:
            self.signs += [index.signature(s).astype("<u2") for s in fresh]

    def row(self) -> pa.RecordBatch:
        fields = [pa.array(c, f.type) for c, f in zip(self.columns, _MEMBER, strict=True)]
        members = pa.StructArray.from_arrays(fields, fields=list(_MEMBER))
        lens = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.blk], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members),
                pa.array([lens.tobytes()], pa.binary()),
                pa.array([b"".join(self.texts)], pa.binary()),
                pa.array([b"".join(x.tobytes() for x in self.signs)], pa.binary()),
            ],
            ["blk", "members", "lens", "texts", "signs"],
        )


def _signed(size: int, index: Index, block_bytes: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << SEQ, 0
        block = _Block(base)
        for batch in batches:
            for piece in slices(batch, min(1 << 20, block_bytes)):
                if block.size >= block_bytes:
                    yield block.row()
                    seq += 1
                    if seq >> SEQ:
                        raise ValueError("a task has too many blocks: use smaller partitions")
                    block = _Block(base | seq)
                block.add(piece, size, index)
        if block.size:
            yield block.row()

    return run


class _Keys:
    """The steps that tell which keys several nodes have; hash ranges of keys are the buckets."""

    def __init__(self, index: Index, size: int, buckets: int):
        self.index, self.size, self.buckets = index, size, buckets
        self.limits = np.array([(i << 64) // buckets for i in range(1, buckets)], U)

    def _owned(self, signs: bytes, notes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, signatures and keys of a block's sets, without those that an earlier block has."""
        signs = np.frombuffer(signs, "<u2").reshape(-1, self.index.chunks * self.index.width)
        own = np.ones(len(signs), bool)
        own[[i for i in notes.column("idx").to_pylist() if i is not None]] = False
        own = np.flatnonzero(own)
        return own, signs[own], self.index.keys(signs[own].astype(U))

    def _cuts(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.searchsorted(keys, self.limits), [len(keys)]))

    def send(self, blocks: pa.Table, notes: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "blk": [], "keys": [], "times": []}
        for blk, signs in zip(blocks.column("blk").to_pylist(), blocks.column("signs").to_pylist(), strict=True):
            key, times = np.unique(self._owned(signs, notes)[2], return_counts=True)
            times = np.minimum(times, 255).astype(np.uint8)
            cut = self._cuts(key)
            for i in np.flatnonzero(np.diff(cut)):
                part = slice(cut[i], cut[i + 1])
                for name, v in zip(out, (int(i), blk, key[part].tobytes(), times[part].tobytes()), strict=True):
                    out[name].append(v)
        kinds = {"bucket": pa.int32(), "blk": pa.int64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    def answer(self, table: pa.Table) -> pa.Table:
        """For each block's keys of a bucket, how many nodes have them (at most 255); 0 for a single one."""
        sizes = [len(x) // 8 for x in table.column("keys").to_pylist()]
        key = np.frombuffer(b"".join(table.column("keys").to_pylist()), U)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8)
        _, of = np.unique(key, return_inverse=True)
        held = np.minimum(np.bincount(of, times), 255).astype(np.uint8)
        held = np.where(held > 1, held, 0).astype(np.uint8)[of]
        ends = np.cumsum([0, *sizes])
        return pa.table(
            {
                "blk": table.column("blk"),
                "bucket": table.column("bucket"),
                "held": pa.array([held[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                "idx": pa.array([None] * len(sizes), pa.int32()),
            }
        )

    def choose(self, blocks: pa.Table, notes: pa.Table) -> pa.Table:
        """The sets with a key that another node has: size, those keys, signature and shingles."""
        told = zip(notes.column("bucket").to_pylist(), notes.column("held").to_pylist(), strict=True)
        held = np.frombuffer(b"".join(h for _, h in sorted(x for x in told if x[1] is not None)), np.uint8)
        nodes, sizes, central, keys, signs, sets = [], [], [], [], [], []
        for blk, lens, texts, packed in zip(*(blocks.column(c).to_pylist() for c in ("blk", "lens", "texts", "signs")), strict=True):
            own, sign, mine = self._owned(packed, notes)
            if not len(own) or not len(held):
                continue
            _, of = np.unique(mine, return_inverse=True)
            times = held[of].reshape(mine.shape)
            rows = np.flatnonzero(times.any(axis=1))
            ends = np.cumsum([0, *np.frombuffer(lens, np.int64)])
            found = shingle_sets([texts[ends[i] : ends[i + 1]] for i in own[rows]], self.size)
            nodes.append((blk << PLACE) | own[rows])
            sizes += map(len, found)
            central.append(times[rows].sum(axis=1, dtype=np.int64))
            keys += [mine[r][times[r] > 0] for r in rows]
            signs += sign[rows].astype(np.int32).tolist()
            sets += found
        cat = lambda a: np.concatenate([np.empty(0, np.int64), *a])
        return pa.table(
            {
                "node": cat(nodes), "n": pa.array(sizes, pa.int64()), "central": cat(central),
                "keys": _lists(keys), "sign": pa.array(signs, pa.list_(pa.int32())), "shingles": _lists(sets),
            }
        )


def _reaches(common: Column, sizes: Column, percent: int) -> Column:
    """Whether sets with ``sizes`` rows in all and ``common`` ones reach the threshold."""
    return (100 + percent) * common >= percent * sizes


def _unreferred() -> list[Column]:
    none = [F.lit(None).cast("long").alias("ref"), F.lit(None).cast("int").alias("common")]
    return [*none, F.lit(False).alias("free"), *_uncounted()]


def _uncounted() -> list[Column]:
    return [F.lit(0).cast("long").alias("crowd"), F.lit(0).cast("long").alias("odds"), F.lit(True).alias("odd")]


def _mixed(live: DataFrame, joined: bool = True) -> DataFrame:
    """Rows of keys whose nodes are of several components; of keys with the same nodes, one stays.

    ``crowd`` is their number, ``odds`` how many of them are outside the key's
    largest component, and ``odd`` tells those. Unless components are
    ``joined``, each node is its own and all but one are odd.
    """
    mix = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    part = live.groupBy(*(["key", "label"] if joined else ["key"])).agg(
        F.count("*").alias("c"), F.max("label").alias("label" if not joined else "l"), F.max("free").alias("f"), *mix
    )
    if joined:
        part = part.groupBy("key").agg(
            F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("c"), F.max("f").alias("f"),
            *(F.bit_xor(x).alias(x) for x in ("x0", "x1")),
        )
    else:
        part = part.withColumn("m", F.struct(F.lit(1).cast("long").alias("c"), "label"))
    keys = part.where("m.c < c").groupBy("c", "f", "x0", "x1").agg(F.min(F.struct("key", "m")).alias("k"))
    keys = keys.select("k.key", F.col("c").alias("crowd"), (F.col("c") - F.col("k.m.c")).alias("odds"), F.col("k.m.label").alias("major"))
    found = live.drop("crowd", "odds", "odd").join(keys, "key")
    return found.withColumn("odd", F.col("label") != F.col("major")).select(*live.columns)


def _roots(refers: DataFrame, scratch: Scratch) -> DataFrame:
    """(pivot, root) of pivots that have a pivot (node, pivot) themselves: where that chain ends.

    It ends, for a pivot is more central than its nodes.
    """
    pivots = refers.select(F.col("pivot").alias("node")).distinct()
    step = refers.join(pivots, "node", "left_semi").select(F.col("node").alias("pivot"), F.col("pivot").alias("root"))
    step = scratch.save(step)
    while True:
        far = step.select(F.col("pivot").alias("root"), F.col("root").alias("far"))
        after = scratch.save(step.join(far, "root", "left").select("pivot", F.coalesce("far", "root").alias("root"), "far"))
        scratch.drop(step)
        step = after.drop("far")
        step._scratch_path = after._scratch_path
        if after.where("far is not null").isEmpty():
            return step


def _cored(refs: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cores of the references' nodes (node, ref, n, rn, common, rest, lost), and links that they prove.

    A reference's core is what most of its near nodes have. Let d(x) be the
    number of shingles that x and the core don't share; two sets differ in
    d(x) + d(y) at most. If that is few enough they are linked, so every node
    is held against the one nearest to the core. Returns (node, ref, n,
    common), the latter with the core; the nodes' shingles outside it that
    another node has (node, ref, s, c), ``c`` their number; links (a, b).
    """
    near = 2 * F.col("common") >= F.greatest("n", "rn")
    size = refs.where(near).groupBy("ref").agg(F.count("*").alias("m"))
    # The reference's own shingles that most near nodes lack aren't of the core.
    scarce = refs.where(near).select("ref", F.explode("lost").alias("s")).groupBy("ref", "s").agg(F.count("*").alias("c"))
    scarce = scarce.join(size, "ref").where(2 * F.col("c") >= F.col("m")).groupBy("ref").agg(F.collect_list("s").alias("scarce"))
    refs = refs.join(scarce, "ref", "left").withColumn("scarce", F.coalesce("scarce", F.array().cast("array<long>")))
    held = F.array_except("scarce", "lost")
    refs = scratch.save(
        refs.select(
            "node", "ref", "n", near.alias("near"), (F.col("common") - F.size(held)).alias("common"),
            (F.col("rn") - F.size("scarce")).alias("core"), F.concat("rest", held).alias("rest"),
        )
    )
    outside = scratch.save(refs.select("ref", "node", "near", F.explode("rest").alias("s")))
    shared = outside.groupBy("ref", "s").agg(F.count("*").alias("c"), F.count_if("near").alias("v")).where("c > 1")
    shared = scratch.save(shared.join(size, "ref").select("ref", "s", "c", (2 * F.col("v") > F.col("m")).alias("most")))
    outside = scratch.save(outside.drop("near").join(shared, ["ref", "s"]))
    more = outside.where("most").groupBy("node").agg(F.count("*").cast("int").alias("more"))
    most = shared.where("most").groupBy("ref").agg(F.count("*").alias("most"))
    zero = F.lit(0)
    found = refs.join(more, "node", "left").join(most, "ref", "left")
    found = found.withColumn("common", F.col("common") + F.coalesce("more", zero))
    apart = F.col("n") + F.col("core") + F.coalesce("most", zero) - 2 * F.col("common")
    found = scratch.save(found.select("node", "ref", "n", "common", ((100 + percent) * apart - (100 - percent) * F.col("n")).alias("over")))
    nearest = found.groupBy("ref").agg(F.min(F.struct("over", "node")).alias("p"))
    links = found.join(nearest, "ref").where((F.col("over") + F.col("p.over") <= 0) & (F.col("node") != F.col("p.node")))
    links = links.select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    return found.drop("over"), outside.where("not most").drop("most"), links


def _referred(live: DataFrame, refs: DataFrame, outside: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """What is left to compare after the cores (see ``_cored``), without squaring large groups.

    Let x and y have one core. What they share lies in it, where it is at most
    what either shares with it, or outside. If the former can't reach the
    threshold, they can only be linked if they share a shingle outside; x
    shares T or more of them with any linked set, T being what it lacks of
    the threshold's share of its size. So it gets keys for its outside
    shingles without the T - 1 commonest (prefix filter); those that no other
    node has are rarer than all. Other pairs of one core meet in one key for
    it, which takes the place of all keys whose nodes have that core; nodes
    that reach the threshold with none aren't entered.
    """
    live = scratch.save(_mixed(live))
    known = refs.join(live.select("node").distinct(), "node", "left_semi")
    live = scratch.save(live.drop("ref", "common").join(known.drop("n"), "node", "left").select(*live.columns))
    group = live.groupBy("key").agg(((F.min("ref") == F.max("ref")) & (F.count("ref") == F.count("*"))).alias("alike"))
    live = scratch.save(live.join(group, "key").withColumn("alike", F.coalesce("alike", F.lit(False))))
    share = F.ceil(F.col("n") * percent / 100)
    least = known.groupBy("ref").agg(F.min("n").alias("least"))
    # A linked set isn't smaller than the threshold's share of this one.
    one = live.where("alike").select("node", "central", "n", "label", "ref", "common").distinct().join(least, "ref")
    one = one.where(_reaches(F.col("common"), F.col("n") + F.greatest("least", share), percent))
    one = one.select("*", F.xxhash64("ref", F.lit("core")).alias("key"), F.lit(False).alias("free"), *_uncounted())
    lacks = F.greatest(F.lit(1), share - F.col("common"))
    rare = outside.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("rare")).join(known, "node")
    rare = rare.select("node", "ref", "rare", (F.size("rare") - lacks + 1).cast("int").alias("k")).where("k > 0")
    free = (
        rare.select("node", "ref", F.explode(F.slice("rare", F.lit(1), F.col("k"))).alias("r"))
        .select(F.xxhash64("ref", "r.s").alias("key"), "node")
        .join(nodes.select("node", "central", "n", "label"), "node")
        .select("key", "node", "central", "n", "label", *_unreferred()[:2], F.lit(True).alias("free"), *_uncounted())
    )
    columns = [c for c in live.columns if c != "alike"]
    return scratch.save(live.where("not alike").select(*columns).unionByName(one.select(*columns)).unionByName(free))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 5,
    percent: int = 80,
    chunks: int = 12,
    width: int = 6,
    distance: int = 36,
    details: bool = False,
    block_bytes: int = 2 << 20,
    bucket_rows: int = 1 << 20,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each input row.

    Two documents are linked if their sets of ``shingle``-word shingles have a
    Jaccard similarity of ``percent`` / 100 or more; ``component_id`` is the
    least id that links reach. With 12 chunks of 6 symbols a pair at exactly
    0.8 is missed with probability 3e-6, and never if fewer than 24 of its 72
    symbols differ. Pairs with over ``distance`` differing symbols are taken as
    unlinked; at 0.8 that has a probability below 1e-9.

    Null or empty texts and texts without words have an empty set and stand
    alone. A null id takes no part in links: its component is null and it is
    kept. Rows that repeat an id are judged each by its own text, so equal rows
    get equal results. An empty input gives an empty result; further columns
    are ignored. A text's memory grows by some 30 bytes a word; a bucket of keys
    holds ``bucket_rows`` of them and one more of a common key for each block
    of ``block_bytes``. With ``details`` each row also has ``mark``, the xxhash64 of
    its text, and ``group``, which tells components apart that have one least
    id (null for empty sets and null ids).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    index = Index(chunks, width)
    marked = docs.withColumn("mark", F.xxhash64("text"))
    signed = marked.mapInArrow(_signed(shingle, index, block_bytes), READ)
    read = scratch.save_bucketed(signed, bucket_count(spark, total, block_bytes), "blk")
    member = read.select(F.explode("members").alias("m")).select("m.*")
    placed = member.where("place is not null")
    nodes = scratch.save(
        placed.groupBy("hash").agg(F.min("place").alias("node"), F.min("id").alias("first"), F.first("n").alias("n"))
    )
    # A set belongs to the first block that has it; notes tell the others.
    copies = placed.select("hash", "place").distinct().join(nodes.select("hash", "node"), "hash").where("place <> node")
    copies = scratch.save(
        copies.select(
            F.shiftright("place", PLACE).alias("blk"),
            F.lit(None).cast("int").alias("bucket"),
            F.lit(None).cast("binary").alias("held"),
            F.col("place").bitwiseAND((1 << PLACE) - 1).cast("int").alias("idx"),
        )
    )
    job = _Keys(index, shingle, max(1, -(-nodes.count() * chunks * width // bucket_rows)))
    sent = (
        read.select("blk", "signs")
        .groupBy("blk")
        .cogroup(copies.groupBy("blk"))
        .applyInArrow(lambda a, b: job.send(a, b), "bucket int, blk long, keys binary, times binary")
    )
    note = "blk long, bucket int, held binary, idx int"
    answers = scratch.save(sent.groupBy("bucket").applyInArrow(lambda t: job.answer(t), note))
    chosen = (
        read.select("blk", "lens", "texts", "signs")
        .groupBy("blk")
        .cogroup(copies.unionByName(answers).groupBy("blk"))
        .applyInArrow(lambda a, b: job.choose(a, b), CHOSEN)
    )
    # Dealt once by node; later joins by node leave signatures and sets where they are.
    dealt = max(bucket_count(spark, total, block_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS))
    chosen = scratch.save_bucketed(chosen.repartition(dealt, "node"), dealt, "node")
    member = scratch.save(member)
    scratch.drop(read, answers, copies)

    def beside(pairs: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """A table of the pivots' values, and the pairs with the node's value (mine) and the pivot's (theirs).

        The pivots' values are saved without buckets, so that pairs of a pivot
        that many nodes meet can be split by the adaptive skew join.
        """
        wanted = pairs.select(F.col("pivot").alias("node")).distinct()
        theirs = chosen.select("node", column).join(wanted, "node", "left_semi")
        theirs = scratch.save(theirs.select(F.col("node").alias("pivot"), F.col(column).alias("theirs")))
        mine = chosen.select("node", F.col(column).alias("mine"))
        return theirs, pairs.join(theirs, "pivot").join(mine, "node")

    def compared(pairs: DataFrame) -> DataFrame:
        """Linked pairs (node, pivot, label, plabel) among those near enough by their signatures, and references' counts.

        For the latter: sizes, what is common, and what each lacks of the other.
        """
        same = F.size(F.filter(F.zip_with("mine", "theirs", lambda x, y: x == y), lambda x: x))
        signs, signed = beside(pairs, "sign")
        near = signed.where(F.col("refer") | (same >= chunks * width - distance))
        near = scratch.save(near.select(*pairs.columns))
        sets, filled = beside(near, "shingles")
        both = F.size(F.array_intersect("mine", "theirs"))
        found = filled.select(
            "node", "pivot", "label", "plabel", both.alias("common"), F.size("mine").alias("n"), F.size("theirs").alias("pn"),
            F.when(F.col("refer"), F.array_except("mine", "theirs")).alias("rest"),
            F.when(F.col("refer"), F.array_except("theirs", "mine")).alias("lost"),
            _reaches(both, F.size("mine") + F.size("theirs"), percent).alias("linked"),
        )
        found = scratch.save(found)
        scratch.drop(signs, near, sets)
        return found

    labels = chosen.select("node", "n", "central", F.col("node").alias("label"))
    live = chosen.select(F.explode("keys").alias("key"), "node", "central", "n", F.col("node").alias("label"), *_unreferred())
    live = scratch.save(_mixed(live, joined=False))
    # Round 0: each node and the pivot of its most crowded key.
    tested, salts = None, 0
    while not live.isEmpty():
        first = salts == 0
        salt = F.pmod(F.xxhash64("node", F.lit(salts)), F.lit(max(1, salts)))
        of = {"node": "pivot", "n": "pn", "label": "plabel", "ref": "pref", "common": "pcommon"}
        # Once the odd nodes of a key are pivots all its open pairs are settled.
        few = F.col("odds") <= (0 if first else salts)
        best = ["central", "node", "n", "label", "ref", "common"]
        pivots = (
            live.where(~few)
            .groupBy("key", salt.alias("salt"))
            .agg(F.max(F.struct(*([] if first else ["odd"]), *best)).alias("p"), F.max("crowd").alias("pcrowd"))
            .select("key", "pcrowd", *(F.col(f"p.{k}").alias(v) for k, v in of.items()))
        )
        if not first:
            every = live.where(few & F.col("odd"))
            pivots = pivots.unionByName(every.select("key", F.col("crowd").alias("pcrowd"), *(F.col(k).alias(v) for k, v in of.items())))
        pivots = scratch.save(pivots)
        rows = live
        if first:
            top = live.groupBy("node").agg(F.max(F.struct("crowd", "key")).alias("m"))
            rows = live.join(top.select("node", F.col("m.key").alias("key")), ["node", "key"], "left_semi")
        # Only pairs that can reach the threshold: by their sizes, and by what they share with a common reference.
        fits = F.lit(100) * F.least("n", "pn") >= F.lit(percent) * F.greatest("n", "pn")
        apart = (F.col("ref") == F.col("pref")) & ~_reaches(F.least("common", "pcommon"), F.col("n") + F.col("pn"), percent)
        refer = F.col("crowd") > CROWD if first else F.lit(False)
        pairs = (
            rows.join(pivots, "key")
            .where((F.col("label") != F.col("plabel")) & (fits | refer) & (F.col("free") | ~F.coalesce(apart, F.lit(False))))
            .select("node", "pivot", "label", "plabel", refer.alias("refer"))
        )
        if first:
            # The reference's own reference takes its place; labels are nodes yet.
            pairs = scratch.save(pairs)
            roots = _roots(pairs.where("refer").select("node", "pivot"), scratch)
            pairs = pairs.join(roots, "pivot", "left").withColumn("pivot", F.coalesce(F.when(F.col("refer"), F.col("root")), "pivot"))
            pairs = pairs.select("node", "pivot", "label", F.col("pivot").alias("plabel"), "refer")
        else:
            # One row for a pair, if both are pivots; a pivot of many nodes stays one.
            pair = [F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y")]
            pairs = pairs.groupBy(*pair).agg(F.max(F.struct(*pairs.columns)).alias("p")).select("p.*")
        if tested is not None:
            old = [F.least("node", "pivot") == F.col("x"), F.greatest("node", "pivot") == F.col("y")]
            pairs = pairs.join(tested, old, "left_anti")
        pairs = scratch.save(pairs)
        checked = compared(pairs)
        done = pairs.select(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y"))
        tested = done if tested is None else tested.unionByName(done)
        links = checked.where("linked").select(F.col("label").alias("a"), F.col("plabel").alias("b"))
        if first:
            refs = checked.where("rest is not null")
            refs = refs.select("node", F.col("pivot").alias("ref"), "n", F.col("pn").alias("rn"), "common", "rest", "lost")
            # A pivot that has no reference is its own.
            own = pivots.where(F.col("pcrowd") > CROWD).select(F.col("pivot").alias("node"), F.col("pn").cast("int").alias("n")).distinct()
            own = own.join(refs.select("node"), "node", "left_anti")
            none = F.array().cast("array<long>")
            own = own.select("node", F.col("node").alias("ref"), "n", F.col("n").alias("rn"), F.col("n").alias("common"), none.alias("rest"), none.alias("lost"))
            refs, outside, proven = _cored(refs.unionByName(own), percent, scratch)
            links = links.unionByName(proven)
        links = links.distinct()
        left = live if first else live.where(~few).join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")
        if not links.isEmpty():
            joined = connected_components(links, scratch).select(F.col("id").alias("label"), "component")
            joined = scratch.save(joined)
            relabel = F.coalesce("component", "label").alias("label")
            left = left.join(joined, "label", "left").select(*live.columns[:4], relabel, *live.columns[5:])
            labels = scratch.save(labels.join(joined, "label", "left").select("node", "n", "central", relabel))
        if first:
            left = _referred(left, refs, outside, labels, percent, scratch)
        old, live = live, scratch.save(_mixed(left))
        scratch.drop(old, pivots, checked)
        salts = 1 if first else salts * 16

    # Nodes that met no other keep their own label.
    named = nodes.join(labels.select("node", "label"), "node", "left").select("hash", "first", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    named = scratch.save(named.join(least, "label").select("hash", "component", "label"))
    out = member.join(named, "hash", "left")
    found = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        found.alias("component_id"),
        F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"),
        *([F.col("mark"), F.when(F.col("id").isNotNull(), F.col("label")).alias("group")] if details else []),
    )
