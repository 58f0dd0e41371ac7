"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 1).

The nodes are distinct vectors, scaled to length 1; equal vectors share a node.
A hash deals them into shards of a bounded size, and each shard has a graph of
its own, built and searched in memory, so no step of a walk is a join. A graph
starts from random-projection blocks and is refined by joins of neighbours of
neighbours: every node gathers the nodes that are its neighbours or have it as
theirs, compares them with each other, and offers each one the others that beat
its present list. Queries walk every shard's graph greedily: they start at a
block's members and keep expanding the best nodes not yet expanded until the
beam no longer changes. A sample of the queries walks first and is compared
with every node; while its walk misses too many neighbours, the beam doubles.
Then all queries walk with that beam; a shard with no more nodes than the beam
is compared as a whole, as a walk would expand every node. Scores are the
cosines of the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(kind) if n else np.empty((0, 1), kind)


def _array(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part, as doubles."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return out.where("id is not null and v is not null").where(~bad).where(F.exists(v, lambda x: x != 0))


def _planes(dim: int, bits: int, trees: int) -> np.ndarray:
    return np.random.default_rng(1).normal(size=(trees, bits, dim))


def _coded(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(vectors, trees): the side of each plane as a number."""
    power = 1 << np.arange(planes.shape[1], dtype=np.int64)
    return np.stack([((unit @ p.T) > 0) @ power for p in planes], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _ranked(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each source's k most similar edges, by source and falling similarity, and their ranks."""
    order = np.lexsort((dst, -sim, src))
    of = src[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    return order[rank < k], rank[rank < k]


def _blocks(u: np.ndarray, codes: np.ndarray, k: int, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (src, dst, sim) to the k nearest in a node's block of each tree; a crowded block is cut into cells."""
    out: list[tuple] = []
    for code in codes.T:
        order = np.argsort(code, kind="stable")
        edge = np.append(np.flatnonzero(np.diff(code[order], prepend=code[order[0]] - 1)), len(order))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            for i in np.array_split(order[lo:hi], max(1, (hi - lo) // cell)):
                m = min(k, len(i) - 1)
                if m < 1:
                    continue
                s = u[i] @ u[i].T
                np.fill_diagonal(s, -2)
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                out.append((np.repeat(i, m), i[top].ravel(), np.take_along_axis(s, top, axis=1).ravel()))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    src, dst, sim = (np.concatenate(x) for x in zip(*out, strict=True))
    _, first = np.unique(src * len(u) + dst, return_index=True)
    return src[first], dst[first], sim[first]


def _offers(u: np.ndarray, members: np.ndarray, fresh: np.ndarray, floor: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node's gathered neighbours, the pairs that beat either one's list; new ones with all."""
    keys, sims = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
    for at in range(0, len(members), step):
        m, f = members[at : at + step], fresh[at : at + step]
        x = u[m]
        s = x @ x.transpose(0, 2, 1)
        there = m >= 0
        fits = (f[:, :, None] | f[:, None, :]) & there[:, :, None] & there[:, None, :]
        fits &= (m[:, :, None] != m[:, None, :]) & (s > floor[m][:, :, None])
        g, a, b = np.nonzero(fits)
        key, first = np.unique(m[g, a] * len(u) + m[g, b], return_index=True)
        keys.append(key)
        sims.append(s[g, a, b][first])
    key, first = np.unique(np.concatenate(keys), return_index=True)
    return key // len(u), key % len(u), np.concatenate(sims)[first]


def build(u: np.ndarray, codes: np.ndarray, *, k: int, sample: int, rounds: int, cell: int) -> np.ndarray:
    """(nodes, 2 k): where a walk may go from each node, the most similar first, filled up with -1.

    ``codes`` are the nodes' blocks in each tree. The graph holds each node's
    k most similar ones found; walks go along edges in both directions.
    """
    n = len(u)
    rng = np.random.default_rng(2)
    src, dst, sim = _blocks(u, codes, k, cell)
    kept, _ = _ranked(src, dst, sim, k)
    src, dst, sim = src[kept], dst[kept], sim[kept]
    fresh = np.ones(len(src), bool)
    for _ in range(rounds):
        held = np.bincount(src, minlength=n)
        floor = np.full(n, np.inf, np.float32)
        np.minimum.at(floor, src, sim)
        floor[held < k] = -2
        # Both directions; each node samples its new and old neighbours on either side.
        members, new = np.full((n, 4 * sample), -1, np.int64), np.zeros((n, 4 * sample), bool)
        for side, (at, to) in enumerate(((src, dst), (dst, src))):
            for old in range(2):
                e = np.flatnonzero(fresh != bool(old))
                e = e[rng.permutation(len(e))]
                e = e[np.argsort(at[e], kind="stable")]
                rank = np.arange(len(e)) - np.searchsorted(at[e], at[e])
                e, rank = e[rank < sample], rank[rank < sample] + sample * (2 * side + old)
                members[at[e], rank] = to[e]
                if not old:
                    new[at[e], rank] = True
                    if not side:
                        used = e
        a, b, s = _offers(u, members, new, floor)
        fresh[used] = False
        # Edges that were there come first, so a repeated one isn't new.
        _, first = np.unique(np.concatenate((src * n + dst, a * n + b)), return_index=True)
        new_edge = first >= len(src)
        fresh = np.concatenate((fresh, np.ones(len(a), bool)))[first]
        src, dst, sim = (np.concatenate(x)[first] for x in ((src, a), (dst, b), (sim, s)))
        kept, _ = _ranked(src, dst, sim, k)
        src, dst, sim, fresh = src[kept], dst[kept], sim[kept], fresh[kept]
        if new_edge[kept].sum() <= 0.001 * k * n:
            break
    ways = np.full((n, 2 * k), -1, np.int32)
    _, first = np.unique(np.concatenate((src * n + dst, dst * n + src)), return_index=True)
    src, dst, sim = (np.concatenate(x)[first] for x in ((src, dst), (dst, src), (sim, sim)))
    kept, rank = _ranked(src, dst, sim, 2 * k)
    ways[src[kept], rank] = dst[kept]
    return ways


def walk(u: np.ndarray, ways: np.ndarray, begin: np.ndarray, q: np.ndarray, beam: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, beam): the nodes that the walks end with and their similarities, -1 where there are none.

    From the nodes ``begin`` (-1: none), the ``expand`` best of a beam that
    aren't expanded are, until all are.
    """
    row = np.arange(len(q))[:, None]
    best = np.full((len(q), beam), -1, np.int64)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    done = np.ones((len(q), beam), bool)
    seen = np.zeros(len(q) * len(u), bool)
    met = begin
    while True:
        at = np.unique((row * len(u) + met)[met >= 0])
        at = at[~seen[at]]
        seen[at] = True
        r, i = at // len(u), at % len(u)
        if len(at):
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            found = np.full((len(q), int(rank.max()) + 1), -1, np.int64)
            sim = np.full(found.shape, -np.inf, np.float32)
            found[r, rank], sim[r, rank] = i, np.einsum("ij,ij->i", u[i], q[r])
            best, done = np.hstack((best, found)), np.hstack((done, found < 0))
            sims = np.hstack((sims, sim))
            top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            best, sims, done = (np.take_along_axis(x, top, axis=1) for x in (best, sims, done))
        ready = np.argsort(done, axis=1, kind="stable")[:, :expand]
        now = ~np.take_along_axis(done, ready, axis=1)
        if not now.any():
            return best, sims
        np.put_along_axis(done, ready, True, axis=1)
        met = np.where(now[:, :, None], ways[np.take_along_axis(best, ready, axis=1)], -1).reshape(len(q), -1)


def _entries(codes: np.ndarray, asked: np.ndarray, each: int) -> np.ndarray:
    """(queries, entry points): some members of the query's block in each tree, and a few nodes for queries in empty blocks."""
    out = [np.broadcast_to(np.arange(min(each, len(codes))), (len(asked), min(each, len(codes))))]
    for code, of in zip(codes.T, asked.T, strict=True):
        order = np.argsort(code, kind="stable")
        place = np.searchsorted(code[order], of)[:, None] + np.arange(each)
        node = order[np.minimum(place, len(order) - 1)]
        out.append(np.where((place < len(order)) & (code[node] == of[:, None]), node, -1))
    return np.hstack(out)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    top: int = 5,
    k: int = 24,
    sample: int = 12,
    rounds: int = 6,
    trees: int = 4,
    cell: int = 256,
    beam: int = 48,
    expand: int = 8,
    recall: float = 0.95,
    probes: int = 256,
    shard: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` nearest found, nearest first.

    Nearness is the cosine of the original vectors in double precision; ties go
    to the smaller id. A query never finds its own id; with fewer candidates it
    gets all found. Vectors that are null, zero, or hold null or non-finite
    components take no part on either side; neither do null ids. Equal vectors
    share a node and are found by their smallest ids; rows that repeat an id
    count once for each distinct vector. Vectors of other lengths than the
    commonest (of equally common ones, the shortest) take no part. Further
    columns are ignored. Empty tables give an empty result.

    ``beam`` is where the walk begins; it grows until ``probes`` sampled queries
    find the share ``recall`` of their neighbours by brute force. ``rounds``
    counts for shards up to 2,048 nodes; every doubling allows one more. Shards
    have about ``shard`` nodes; a task holds one with a pack of queries.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = scratch.save(clean(vectors, id_col, vector_col).withColumn("node", F.xxhash64("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    # Lengths are settled before vectors are packed into matrices.
    rows = rows.where(F.size("v") == lengths.d)
    asked = scratch.save(clean(queries, id_col, vector_col).where(F.size("v") == lengths.d).distinct())
    # A node's members: as many of its smallest ids as a result can need.
    members = rows.select("node", "id").distinct()
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    for by in (["node", "part"], ["node"]):
        members = members.withColumn("part", part) if by[-1] == "part" else members
        w = Window.partitionBy(*by).orderBy("id")
        members = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 1).drop("r")
    members = members.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = rows.groupBy("node").agg(F.first("v").alias("v"))

    def unit(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), _array(_unit(_matrix(batch.column("v"))), pa.float32())], ["node", "u"]
                )

    nodes = scratch.save(distinct.mapInArrow(unit, "node long, u array<float>"))
    count = nodes.count()
    if not count or asked.isEmpty():
        return empty
    shards = -(-count // shard)
    bits = max(0, int(np.ceil(np.log2(max(1, count / shards / (cell / 2))))))
    planes = _planes(lengths.d, bits, trees)

    def graph(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy())
        ids, u = table.column("node").to_numpy()[order], _matrix(table.column("u"), np.float32)[order]
        codes = _coded(u.astype(np.float64), planes)
        more = max(0, int(np.ceil(np.log2(len(ids)))) - 11)
        ways = build(u, codes, k=k, sample=sample, rounds=rounds + more, cell=cell)
        parts = {"ids": ids, "us": u, "ways": ways, "codes": codes}
        return pa.table({n: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for n, x in parts.items()})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(shards)))
    # More partitions than shards, so that few shards share a task.
    dealt = dealt.repartition(max(shards, min(4 * shards, 512)), "shard")
    graphs = scratch.save(dealt.groupBy("shard").applyInArrow(graph, "ids binary, us binary, ways binary, codes binary"))

    def asked_unit(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), _array(_unit(_matrix(batch.column("v"))), pa.float32())], ["query", "q"])

    units = scratch.save(asked.mapInArrow(asked_unit, "query long, q array<float>"))
    held = max(beam, 4 * top)

    def walked(units: DataFrame, beam: int, expand: int) -> DataFrame:
        """(query, node, sim): the best nodes that the queries' walks through every shard end with."""

        def run(batches):
            for batch in batches:
                for ids, us, ways, codes, queries, qs in zip(*batch.columns, strict=True):
                    ids, queries, codes = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, queries, codes))
                    u, q = (np.frombuffer(x.as_buffer(), np.float32).reshape(len(i), -1) for x, i in ((us, ids), (qs, queries)))
                    ways, codes = np.frombuffer(ways.as_buffer(), np.int32).reshape(len(ids), -1), codes.reshape(len(ids), -1)
                    for at in range(0, len(q), 128):
                        part = q[at : at + 128]
                        if beam >= len(ids):
                            sims = part @ u.T
                            best = np.argsort(-sims, axis=1, kind="stable")[:, :held]
                            sims = np.take_along_axis(sims, best, axis=1)
                        else:
                            begin = _entries(codes, _coded(part.astype(np.float64), planes), expand)
                            best, sims = (x[:, :held] for x in walk(u, ways, begin, part, beam, expand))
                        there = best >= 0
                        of = np.broadcast_to(queries[at : at + 128, None], best.shape)
                        yield pa.RecordBatch.from_arrays([pa.array(of[there]), pa.array(ids[best[there]]), pa.array(sims[there])], ["query", "node", "sim"])

        pairs = graphs.crossJoin(packs(units))
        found = pairs.mapInArrow(run, "query long, node long, sim float")
        return scratch.save(found.groupBy("query", "node").agg(F.max("sim").alias("sim")))

    def packs(units: DataFrame) -> DataFrame:
        return scratch.save(_packed(units, "query", "q", 1024))

    own = asked.select(F.col("id").alias("query"), F.xxhash64("v").alias("node"))
    probe = scratch.save(asked.select("id").distinct().orderBy(F.xxhash64("id")).limit(probes).select(F.col("id").alias("query")))
    tried = scratch.save(units.join(F.broadcast(probe), "query"))
    truth = _nearest(tried, nodes, top + 1).join(own, ["query", "node"], "left_anti")
    truth = scratch.save(_first(truth, top).select("query", "node"))
    wanted = truth.count()
    while beam < 2 * shard:
        found = walked(tried, beam, expand)
        met = _first(found, held).select("query", "node")
        hit = truth.join(met, ["query", "node"], "left_semi").count()
        scratch.drop(found)
        if hit >= recall * wanted:
            break
        beam, expand = 2 * beam, 2 * expand
    # A query's own node holds its copies.
    best = _first(walked(units, beam, expand), held).select("query", "node").union(own).distinct()
    exact = best.join(distinct, "node").join(asked.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query")

    def cosine(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column("v")), _matrix(batch.column("qv"))
                # One order of summing for every row, so equal vectors score alike.
                a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
                score = np.array([float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))) for x, y in zip(a, b, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(score)], ["query", "node", "score"])

    scored = exact.select("query", "node", "v", "qv").mapInArrow(cosine, "query long, node long, score double")
    pairs = scored.join(members, "node").select("query", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query")
    pairs = pairs.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top)
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _first(found: DataFrame, n: int) -> DataFrame:
    """The n most similar nodes of each query."""
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def _nearest(units: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(query, node, sim): by brute force, at least the n most similar nodes of each query.

    Queries and nodes meet in packs, so a pack's pairs are one matrix product.
    """

    def run(batches):
        for batch in batches:
            for ids, us, queries, qs in zip(*(batch.column(c) for c in ("node", "u", "query", "q")), strict=True):
                ids, queries = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, queries))
                u, q = (np.frombuffer(x.as_buffer(), np.float32).reshape(len(i), -1) for x, i in ((us, ids), (qs, queries)))
                s = q @ u.T
                m = min(n, len(ids))
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(queries, m)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(s, best, axis=1).ravel())],
                    ["query", "node", "sim"],
                )

    pairs = _packed(nodes, "node", "u", 4096).crossJoin(_packed(units, "query", "q", 256))
    return pairs.mapInArrow(run, "query long, node long, sim float")


def _packed(frame: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Packs of up to ``size`` keys and vectors, each in one binary value."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = _matrix(part.column(vector), np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(key).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], [key, vector]
                )

    return frame.select(key, vector).mapInArrow(run, f"{key} binary, {vector} binary")
