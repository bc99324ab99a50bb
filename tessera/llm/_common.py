"""What the operators share: the shared work folder, written tables, and joins that survive a hot key."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a small side that may be broadcast, with rows of at most ~100 bytes: about 25 MB.
BROADCAST_ROWS = 250_000

_own_dir: list[str] = []
_written: dict[str, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder for intermediate tables")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own_dir[0]


@contextmanager
def _short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write are deleted when it ends: what it wrote is read from now on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = _table_path(spark, name)
    with _short_lived_shuffles(spark):
        df.write.parquet(path, compression=codec)
    _written[path] = out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)
    return out


def bucket_numbers(part: int, buckets: int) -> Iterator[int]:
    """Numbers that only task ``part`` draws, all of which Spark puts in bucket ``part % buckets``."""
    at = part << 36
    while True:
        x = np.arange(at, at + 4 * buckets, dtype=np.int64)
        for k in np.flatnonzero(_murmur3(x) % buckets == part % buckets).tolist():
            yield int(x[k])
        at += 4 * buckets


def _murmur3(x: np.ndarray) -> np.ndarray:
    """Spark's hash of longs (Murmur3 of two 32-bit halves, seed 42), as non-negative residues can be taken of it."""
    mask = np.uint64(0xFFFFFFFF)
    turn = lambda v, r: ((v << np.uint64(r)) | (v >> np.uint64(32 - r))) & mask
    h = np.full(len(x), 42, np.uint64)
    for half in (x.view(np.uint64) & mask, x.view(np.uint64) >> np.uint64(32)):
        k = turn(half * np.uint64(0xCC9E2D51) & mask, 15) * np.uint64(0x1B873593) & mask
        h = (turn(h ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & mask
    h ^= np.uint64(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by) & mask
    return h.astype(np.uint32).view(np.int32).astype(np.int64)


def written_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`written`, as a table in buckets of ``key``: a join by it does not shuffle this side."""
    spark = df.sparkSession
    path, table = _table_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    with _short_lived_shuffles(spark):
        df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    _written[path] = out = spark.table(table)
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> int:
    """Delete written tables that nothing reads any more (those given, or all so far). How many there were."""
    gone = [p for p, t in _written.items() if not tables or any(t is x for x in tables)]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _written[path]
    return len(gone)


def trim() -> None:
    """Give what a Python worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """``run`` over a task's batches, and :func:`trim` when it ends: workers live on between stages."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return wrapped


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size; 0 if it has none."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 60 else 0


def empty_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def id_text(col: Column) -> Column:
    """An id as text; a null id reads ``null``."""
    return F.coalesce(col.cast("string"), F.lit("null"))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_text(col).cast("binary")), F.lit(n).cast("long"))


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named columns, under names of ours: other columns cannot clash with what an operator adds."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the counted size is within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def join_hot(left: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """``left`` left-joined to ``groups`` (unique by ``key``; ``size`` = left rows of the key).

    At most ``share`` groups can hold a ``1/share`` part of ``total`` rows each, so those are broadcast (a bound by
    counting, whatever the data) and only the rows of smaller groups shuffle.
    """
    least = max(2, total // share)
    hot = groups.filter(F.col(size) >= least)
    hit = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) < least), key, "left")
    return hit.unionByName(rest)
