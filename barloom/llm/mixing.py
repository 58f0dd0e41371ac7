"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 7).

Targets: the budget is shared by weight; a source whose share exceeds its limit
keeps the limit, and the excess is shared again by weight. A source takes each
document once for every whole epoch of its target, then a weighted sample
without replacement: every document draws an exponential variate, divided by
its quality weight, and the documents with the least keys fill the rest.

Sorted order is never materialized for a source: keys fall into ranges, sums
by range find the range in which the budget ends, and that range alone is
divided again, level by level; at the last level its few rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FAN = 1024  # ranges at each level


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: list[float], share: float, limit: float) -> dict:
    """Target of each source: by weight (repeating, in code-point order, null last), at most limit times its size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: limit * n for s, n in order}
    left, out = share * sum(n for _, n in order), {}
    open_ = [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not full:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            out[s] = cap[s]
        left -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


MARKS = "0123456789!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


def quality(text: Column) -> Column:
    """A weight from 0.25 to 1 that falls with the share of ASCII digits and marks in a text."""
    plain = F.length(F.translate(text, MARKS, ""))
    return F.coalesce(0.25 + 0.75 * F.try_divide(plain, F.length(text)), F.lit(0.25))


def _hex(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    weight: Column | None = None,
    seed: int = 7,
) -> DataFrame:
    """The input's columns, then size, source_size, target and taken.

    ``taken`` is a document's size times the epochs that take it, ``limit`` at
    most. The sample's draws are hashes of id (if null, of the text) and seed,
    so reruns agree; rows that repeat an id draw alike and go together.
    Null and empty texts have size 0 and take nothing. A null source is a
    source of its own, the last; a null id is a document like others. An empty
    input gives an empty result. Input columns with the names of results are
    replaced.

    The number of sources is taken as bounded (their targets pass the driver);
    the number of documents isn't.
    """
    if limit < 1 or limit != int(limit):
        raise ValueError("limit is a whole number: documents are taken whole")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.drop("size", "source_size", "target", "taken")
    size = words(F.col(text_col))
    totals = docs.groupBy(F.col(source_col).alias("s")).agg(F.sum(size).alias("n")).collect()
    sizes = {r.s: int(r.n) for r in totals}
    found = targets(list(sizes.items()), list(weights), share, limit)
    plan = spark.createDataFrame(
        [(s, n, float(found[s]), _epochs(found[s], n), _rest(found[s], n)) for s, n in sizes.items()],
        "s string, source_size long, target double, epochs long, rest double",
    )
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit("")), F.lit(f":{seed}")))
    # A uniform draw in (0, 1) from 52 bits; the rest of the digest settles ties.
    uniform = (_hex(digest, 1, 13).cast("double") + 0.5) / F.lit(float(1 << 52))
    key = -F.ln(uniform) / (weight if weight is not None else quality(F.col(text_col)))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(source_col).cast("string").alias("s0"),
        size.alias("size"),
        key.alias("key"),
        _hex(digest, 17, 14).alias("tie"),
    )
    rows = rows.join(F.broadcast(plan), F.col("s0").eqNullSafe(F.col("s"))).drop("s0")
    cuts = _cuts(rows.select("s", "size", "key", "tie", "rest"), scratch)
    at = spark.createDataFrame(cuts, "cs string, cut double, ctie long") if cuts else None
    if at is None:
        extra = F.lit(0)
    else:
        rows = rows.join(F.broadcast(at), F.col("s").eqNullSafe(F.col("cs")), "left")
        before = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("tie") <= F.col("ctie")))
        extra = F.when(F.coalesce(before, F.lit(False)), 1).otherwise(0)
    epochs = F.least(F.col("epochs") + extra, F.lit(int(limit)))
    return rows.select("row.*", "size", "source_size", "target", (F.col("size") * epochs).alias("taken"))


def _epochs(target: float, n: int) -> int:
    return int(target // n) if n else 0


def _rest(target: float, n: int) -> float:
    return float(target - n * (target // n)) if n else 0.0


def _cuts(rows: DataFrame, scratch: Scratch) -> list[tuple]:
    """For each source, the (key, tie) of the last row that its fractional budget takes.

    Each level sums sizes by source and range in the executors and picks the
    range in which the sum passes the budget; only that range goes on. The
    driver sees one row of a source.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    live = rows.where("rest > 0 and size > 0").select("s", "size", "key", "tie", "rest")
    bounds = live.groupBy("s").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("rest").alias("need"), F.count("*").alias("rows")
    )
    state = [(r.s, r.lo, r.hi, float(r.need), r["rows"]) for r in bounds.collect()]
    done: list[tuple] = []
    narrow = scratch.save(live.drop("rest"))
    order = Window.partitionBy("s").orderBy("bin")
    while state:
        small = [x for x in state if x[4] <= FAN or x[1] >= x[2]]
        large = [x for x in state if not (x[4] <= FAN or x[1] >= x[2])]
        kind = "c string, lo double, hi double, need double, n long"
        if small:
            # The last rows of a source: at most FAN of them, or all with one key.
            part = narrow.join(F.broadcast(spark.createDataFrame(small, kind)), F.col("s").eqNullSafe(F.col("c")))
            part = part.where("key between lo and hi").groupBy("s", "key", "tie").agg(F.sum("size").alias("size"), F.first("need").alias("need"))
            w = Window.partitionBy("s").orderBy("key", "tie")
            part = part.withColumn("sum", F.sum("size").over(w)).where(F.col("sum") - F.col("size") / 2 <= F.col("need"))
            last = part.groupBy("s").agg(F.max(F.struct("key", "tie")).alias("m"))
            hit = {r.s: r.m for r in last.collect()}
            for s, lo, *_ in small:
                # Nothing of the last range fits: all keys before it are taken.
                done.append((s, float(hit[s].key), int(hit[s].tie)) if s in hit else (s, float(lo), -(1 << 63)))
        state = []
        if large:
            part = narrow.join(F.broadcast(spark.createDataFrame(large, kind)), F.col("s").eqNullSafe(F.col("c")))
            width = F.col("hi") - F.col("lo")
            bin_ = F.least(F.lit(FAN - 1), F.floor((F.col("key") - F.col("lo")) / width * FAN))
            sums = part.where("key between lo and hi").groupBy("s", bin_.alias("bin")).agg(
                F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"),
                F.count("*").alias("rows"), F.first("need").alias("need"),
            )
            sums = sums.withColumn("before", F.sum("size").over(order) - F.col("size"))
            at = sums.where("before < need").groupBy("s").agg(F.max(F.struct("bin", "lo", "hi", "before", "need", "rows")).alias("m"))
            state = [(r.s, r.m.lo, r.m.hi, float(r.m.need - r.m.before), r.m.rows) for r in at.collect()]
    return done
