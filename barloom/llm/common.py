"""Shared helpers: scratch tables in the shared folder, text access, components.

Lineage is cut only by tables written under ``spark.checkpoint.dir``, which
every executor can read, so a lost executor costs a recomputation at most.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import threading
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    That is ``spark.checkpoint.dir``, else the checkpoint folder set on the
    context, else a folder of the warehouse, which executors can read as well.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def trim() -> None:
    """Gives free memory back to the system: workers are used again, by other operators too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches, after whose last one free memory goes back, and the held model if none asks for it soon."""

    @functools.wraps(run)
    def tidied(*args):
        try:
            yield from run(*args)
        finally:
            settle()

    return tidied


#: Seconds for which a worker holds a model that no task uses. Spark takes idle workers in turn: where a stage before has
#: left more of them than there are cores, each would hold a model, also while other operators run.
IDLE = 1.0
_MODEL: dict[Hashable, Any] = {}
_LOCK = threading.RLock()
_TIMER: list[threading.Timer] = []


def held_model(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one model that a worker holds; another operator's goes first. Between tasks it stays for ``IDLE`` seconds."""
    with _LOCK:
        while _TIMER:
            _TIMER.pop().cancel()
        if key not in _MODEL:
            _MODEL.clear()
            trim()
            _MODEL[key] = make()
        return _MODEL[key]


def settle() -> None:
    """After a task: free memory goes back now, the held model later. Tasks that don't use it don't put that off."""
    trim()
    with _LOCK:
        if _MODEL and not _TIMER:
            _TIMER.append(timer := threading.Timer(IDLE, lambda: _let_go(timer)))
            timer.daemon = True
            timer.start()


def _let_go(timer: threading.Timer) -> None:
    with _LOCK:
        if timer not in _TIMER:  # a task has come in between
            return
        _TIMER.clear()
        _MODEL.clear()
    trim()


_OPEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def close_scratch(spark: SparkSession, keep: Scratch | None = None) -> None:
    """Removes the scratch tables of every operator called since the last time, but for those of ``keep``.

    For the owner of the results, once they are written: results that aren't
    yet read can't be read any more.
    """
    for owner, root in [x for x in _OPEN if x[0] is spark and (keep is None or x[1] != keep.root)]:
        _delete(owner, root)
        _OPEN.remove((owner, root))


class Scratch:
    """Intermediate tables of one operator call.

    ``save`` writes a frame and reads it back; ``drop`` removes a table that no
    later plan reads. Tables that the returned frame still reads stay until the
    owner of the results calls ``close_scratch``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _OPEN.append((spark, self.root))

    def _path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self._path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_bucketed(self, df: DataFrame, count: int, column: str, compression: str = "zstd") -> DataFrame:
        """A table bucketed by a column, so that later groups and joins by it don't shuffle it.

        The catalog forgets it as soon as the frame knows its files.
        """
        path, name = self._path(), f"scratch_{uuid.uuid4().hex}"
        try:
            df.write.bucketBy(count, column).option("path", path).option("compression", compression).saveAsTable(name)
            out = self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._scratch_path)


def bucket_count(spark: SparkSession, total: int, block_bytes: int, blocks: int = 4) -> int:
    """Buckets for a table of blocks: about ``blocks`` in each, as far as Spark allows."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return max(1, min(most, -(-total // (blocks * block_bytes))))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, budget: int = 8 << 20, column: str = "text"):
    """Cut a batch so that each piece holds about ``budget`` bytes of text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b long); component: least id.

    Alternating large-star and small-star rounds. Each star takes the minimum
    by a partial aggregation, then joins it back to the edges, so that a hot
    node is split by the adaptive skew join instead of meeting in one task.
    """
    e = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = e.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least.select(F.col("u").alias("c"), F.least("m", "u").alias("m")), F.col("u") == F.col("c"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = scratch.save(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least.select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c"))
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, e = e, scratch.save(small)
        scratch.drop(old, large)
    child = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return child.unionByName(child.select(F.col("component").alias("id"), "component").distinct())
