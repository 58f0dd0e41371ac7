"""Sharding by a k-d tree over metadata (operator 4).

All documents start in one node. Each level splits every node that is to hold
more than one leaf, at the weighted median (or the weighted quantile, if its
number of leaves is odd) of sizes along its widest dimension, widths taken
relative to the whole table's. Medians are exact and distributed: sizes are
summed by node and range in the executors, the range that holds the median is
divided again, and the driver sees one row of a node.

Rows are ordered by the dimension, then by the text's hash, then by id, so equal
texts are neighbours. A cut that falls among equal texts moves to their nearer
end if that shifts less than ``slack`` of a leaf; otherwise it divides them, as
sizes near equal come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FAN = 1024


def text_dimensions(text: Column) -> list[Column]:
    """Dimensions that equal texts share: characters, bytes a character, and shares of spaces and of digits."""
    chars, size = (F.coalesce(f(text).cast("long"), F.lit(0)) for f in (F.length, F.octet_length))
    spaces, digits = (chars - F.coalesce(F.length(F.translate(text, x, "")).cast("long"), F.lit(0)) for x in (" ", "0123456789"))
    return [chars, *(F.coalesce(F.try_divide(n * 1_000_000, chars), F.lit(0)).cast("long") for n in (size, spaces, digits))]


def _crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def kd_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shards: int | None = None,
    target_bytes: int = 1 << 30,
    dimensions: list[Column] | None = None,
    slack: float = 0.01,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row for each input row.

    Size is the text's bytes plus 1, so null and empty texts have size 1. The
    number of shards is given, or the fewest that ``target_bytes`` allow. Slots
    count from 0 in each shard without gaps. Null dimensions count as the
    lowest value, null ids come first among equal texts; equal rows are told
    apart by no order and stay together at a cut. With fewer rows than shards
    some shards stay empty; an empty input gives an empty result. Further
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col)
    dims = dimensions if dimensions is not None else text_dimensions(text)
    low = F.lit(-(1 << 62))
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            _crc(text).alias("crc"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("k2"),
            F.coalesce(F.col(id_col).cast("long"), low).alias("k3"),
            F.array(*(F.coalesce(d.cast("long"), low) for d in dims)).alias("dims"),
            F.lit(0).alias("node"),
        )
    )
    number = len(dims)
    spread = [f(F.get("dims", F.lit(i))).alias(f"{n}{i}") for i in range(number) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("size").alias("size"), *spread).first()
    total = whole["size"] or 0
    leaves = shards or max(1, -(-total // target_bytes))
    wide = [max(1, (whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0)) for i in range(number)]
    # A node is named by its first leaf; ``plan`` has the number of leaves of each.
    plan = {0: leaves}
    while any(n > 1 for n in plan.values()):
        found = rows.groupBy("node").agg(F.sum("size").alias("size"), *spread).collect()
        cuts = []
        for r in found:
            n = plan[r.node]
            if n > 1:
                d = max(range(number), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / wide[i], -i))
                cuts.append((r.node, d, r[f"lo{d}"], r[f"hi{d}"], float(r["size"]) * (n // 2) / n, r.node + n // 2))
        if cuts:
            split = _split(rows, cuts, scratch, slack * total / leaves)
            old, rows = rows, scratch.save(split)
            scratch.drop(old)
        plan = {m: k for node, n in plan.items() for m, k in ([(node, n)] if n == 1 else [(node, n // 2), (node + n // 2, n - n // 2)])}
    rows = rows.withColumnRenamed("node", "shard")
    counted = rows.count()
    # Slots: numbers within a bucket of a shard, after all rows of the shard's earlier buckets.
    bucket = F.pmod(F.xxhash64("id", "k2"), F.lit(max(1, counted // (leaves * 5000)))).cast("int")
    rows = rows.withColumn("bucket", bucket)
    ahead = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = ahead.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "k2"))
    rows = rows.withColumn("within", within).join(ahead, ["shard", "bucket"])
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("ahead") + F.col("within") - 1).cast("long").alias("slot"),
    )


def _split(rows: DataFrame, cuts: list[tuple], scratch: Scratch, slack: float) -> DataFrame:
    """Rows with the node of the next level; cuts: (node, dimension, lowest, highest, size to the left, right node)."""
    spark = rows.sparkSession
    dims = {c[0]: c[1] for c in cuts}
    by = spark.createDataFrame([(c[0], c[1]) for c in cuts], "n0 int, dim int")
    keyed = scratch.save(
        rows.join(F.broadcast(by), F.col("node") == F.col("n0")).select("node", F.get("dims", F.col("dim")).alias("k1"), "k2", "k3", "size")
    )
    # A range of each node: keys fixed so far, the key under division, its bounds, the size still to go left.
    state = [(c[0], (), c[2], c[3], c[4], None) for c in cuts]
    done: dict[int, tuple] = {}
    while state:
        small = [s for s in state if s[5] is not None and s[5] <= FAN or len(s[1]) == 2 and s[2] >= s[3]]
        large = [s for s in state if s not in small]
        state = []
        for part, last in ((small, True), (large, False)):
            if not part:
                continue
            at = spark.createDataFrame(
                [(n, *(list(fix) + [None] * (2 - len(fix))), len(fix) + 1, int(lo), int(hi), float(need)) for n, fix, lo, hi, need, _ in part],
                "n0 int, f1 long, f2 long, level int, lo long, hi long, need double",
            )
            key = F.when(F.col("level") == 1, F.col("k1")).when(F.col("level") == 2, F.col("k2")).otherwise(F.col("k3"))
            live = (
                keyed.join(F.broadcast(at), F.col("node") == F.col("n0"))
                .withColumn("key", key)
                .where("(level = 1 or k1 = f1) and (level < 3 or k2 = f2) and key between lo and hi")
            )
            if last:
                w = Window.partitionBy("node").orderBy("k1", "k2", "k3")
                live = live.groupBy("node", "k1", "k2", "k3").agg(F.sum("size").alias("size"), F.first("need").alias("need"))
                live = live.withColumn("sum", F.sum("size").over(w))
                fits = live.where(F.col("sum") - F.col("size") / 2 <= F.col("need"))
                got = {r.node: r.m for r in fits.groupBy("node").agg(F.max(F.struct("k1", "k2", "k3")).alias("m")).collect()}
                for n, fix, lo, *_ in part:
                    m = got.get(n)
                    # Nothing of the range fits: what comes before it goes left.
                    done[n] = (m.k1, m.k2, m.k3) if m else ((*fix, int(lo)) + (-(2**63),) * 2 if len(fix) < 2 else (*fix, max(int(lo) - 1, -(2**63))))[:3]
                continue
            # The widest ranges divide in doubles, as their width overflows; later ones exactly.
            rough = (F.col("key").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double"))
            exact = F.try_divide((F.col("key") - F.col("lo")).cast("double"), (F.col("hi") - F.col("lo")).cast("double"))
            vast = F.col("hi").cast("double") - F.col("lo").cast("double") > 2.0**62
            place = F.coalesce(F.when(vast, rough).otherwise(exact), F.lit(0.0)) * FAN
            bins = live.groupBy("node", F.least(F.lit(FAN - 1), F.floor(place)).alias("bin")).agg(
                F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("need").alias("need")
            )
            before = F.sum("size").over(Window.partitionBy("node").orderBy("bin")) - F.col("size")
            bins = bins.withColumn("before", before).where("before <= need")
            got = {r.node: r.m for r in bins.groupBy("node").agg(F.max(F.struct("bin", "lo", "hi", "before", "need", "rows")).alias("m")).collect()}
            for n, fix, lo, hi, need, _ in part:
                m = got[n]
                if m.lo >= m.hi and len(fix) < 2:
                    # One value of this key: go on with the next key.
                    state.append((n, (*fix, m.lo), -(1 << 63), (1 << 63) - 1, m.need - m.before, m.rows))
                else:
                    state.append((n, fix, m.lo, m.hi, m.need - m.before, m.rows))
    # Move a cut that divides equal texts to their nearer end, within the slack.
    at = spark.createDataFrame([(n, *map(int, c)) for n, c in done.items()], "n0 int, c1 long, c2 long, c3 long")
    same = keyed.join(F.broadcast(at), F.col("node") == F.col("n0")).where("k1 = c1 and k2 = c2")
    left = F.sum(F.when(F.col("k3") <= F.col("c3"), F.col("size")).otherwise(0))
    for r in same.groupBy("node").agg(left.alias("left"), F.sum("size").alias("all")).collect():
        c = done[r.node]
        more = r["all"] - r["left"]
        if more and min(more, r["left"]) <= slack:
            done[r.node] = (c[0], c[1], 2**63 - 1 if more <= r["left"] else -(2**63))
    nodes = [(c[0], c[5], dims[c[0]], *map(int, done[c[0]])) for c in cuts]
    at = spark.createDataFrame(nodes, "n0 int, right int, dim int, c1 long, c2 long, c3 long")
    out = rows.join(F.broadcast(at), F.col("node") == F.col("n0"), "left")
    k1 = F.get("dims", F.col("dim"))
    left = (k1 < F.col("c1")) | ((k1 == F.col("c1")) & ((F.col("k2") < F.col("c2")) | ((F.col("k2") == F.col("c2")) & (F.col("k3") <= F.col("c3")))))
    node = F.when(F.col("n0").isNull() | left, F.col("node")).otherwise(F.col("right"))
    return out.select(*[node.alias("node") if c == "node" else c for c in rows.columns])
