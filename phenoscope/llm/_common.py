"""Helpers that the corpus operators share: scratch tables and ranks that no
single task has to compute alone."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own_root: str | None = None
_cache: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """What an operator remembers between the batches and tasks of a Python
    worker. A worker keeps the memory of one operator only: the next one that
    asks for its own drops it, so stages that follow each other don't add up."""
    if name not in _cache:
        _cache.clear()
        give_back()
        _cache[name] = make()
    return _cache[name]


#: Rows of texts that travel to a Python worker and back at once.
ARROW_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of the session hold ARROW_ROWS rows at most: executors
    keep the buffers of the largest batch, on both sides, and texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def give_back() -> None:
    """Returns to the system what the allocators of this worker hold unused."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def leaving(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` for ``mapInArrow``, giving memory back when a task ends, so that
    workers that wait between stages don't keep the largest batch they had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or
    a temporary folder where a local session names none (tests)."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="phenoscope-")
    return _own_root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts
    the lineage, survives lost executors and keeps the scan of the texts from
    being repeated."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_table(df: DataFrame, name: str, key: str | None = None, parts: int = 1) -> str:
    """Like ``materialise``, as a table of a database in the shared folder, so
    that ``DROP TABLE`` gives its disk back; its name is returned. With ``key``
    its rows lie in ``parts`` buckets: what groups or joins by the key later
    doesn't shuffle them again. Give rows that are dealt by ``key`` into
    ``parts`` then, so each task writes one file."""
    spark, root = df.sparkSession, scratch_root(df.sparkSession)
    database = f"phenoscope_{zlib.crc32(root.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/{database}'")
    table = f"{database}.{name}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if key:
        # buckets would be given up where an explode stands between scan and grouping
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        writer = writer.bucketBy(parts, key)
    writer.saveAsTable(table)
    return table


#: Rows of ids or other short rows that may be broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def small_side(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` marked for a broadcast if it has few enough rows; a join with
    it is a shuffle otherwise. ``table`` is counted: give a written one."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str], count: str, hot: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key
    and says in ``count`` how many of ``rows`` have it. Keys of more than
    ``hot`` rows are few: they are broadcast, so none is one task's work."""
    often = materialise(table.where(F.col(count) > hot).drop(count), "hot-keys")
    rest = table.where(F.col(count) <= hot).drop(count)
    out = rows.join(small_side(often), keys).unionByName(rows.join(small_side(often.select(keys)), keys, "left_anti").join(rest, keys))
    return out if often.limit(1).count() else rows.join(rest, keys)


def each_copy(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` numbering the copies of equal rows from 0; a row's
    copies are laid out over many tasks."""
    runs = df.groupBy(*df.columns).agg(F.count("*").alias("_rt_n"))
    lows = F.explode(F.expr("sequence(0L, _rt_n - 1, 4096L)"))
    runs = runs.withColumn("_rt_lo", lows).repartition(*df.columns, "_rt_lo")
    return runs.withColumn(name, F.explode(F.expr("sequence(_rt_lo, least(_rt_lo + 4095L, _rt_n - 1))"))).select(*df.columns, name)


def buckets_for(rows: int, each: int = 500) -> int:
    """Buckets so that one of them holds about ``each`` rows."""
    return max(1, math.ceil(rows / each))


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    buckets: int,
    deal: list[str] | None = None,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one among
    the rows with equal ``keys`` (which must not be null).

    The rows of a key are dealt over ``buckets`` by a hash of ``deal`` (by default
    ``order``; leave out what differs between reruns), summed
    per bucket, and only the bucket sums are accumulated in sequence, so a key
    that holds a large share of the rows is still spread over many tasks. The
    order is by bucket, then by ``order``; it depends on the rows alone.
    """
    b, v, off, start = "_rt_bucket", "_rt_value", "_rt_sum", "_rt_start"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*(deal or order)), F.lit(buckets)).cast("int")).withColumn(v, value.cast("long"))
    sums = dealt.groupBy(*keys, b).agg(F.sum(v).alias(off))
    starts = _bucket_starts(sums, keys, b, off, start, buckets)
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(starts, [*keys, b])
        .withColumn(out, F.col(start) + F.coalesce(F.sum(v).over(inside), F.lit(0)))
        .select(*df.columns, out)
    )


def _bucket_starts(sums: DataFrame, keys: list[str], b: str, off: str, start: str, buckets: int) -> DataFrame:
    """Sums of the buckets before each one; of many buckets in two levels."""
    if buckets <= 1 << 14:
        before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*keys, b, F.coalesce(F.sum(off).over(before), F.lit(0)).alias(start))
    wide, first = "_rt_wide", "_rt_first"
    sums = sums.withColumn(wide, (F.col(b) / (1 << 12)).cast("int"))
    tops = _bucket_starts(sums.groupBy(*keys, wide).agg(F.sum(off).alias(off)), keys, wide, off, first, 1)
    inside = Window.partitionBy(*keys, wide).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(tops, [*keys, wide]).select(*keys, b, (F.col(first) + F.coalesce(F.sum(off).over(inside), F.lit(0))).alias(start))


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` (written ones) with their place in ``order``, from 1: a sort by
    ranges, places in each range, and the rows of the ranges before it. Let
    ``order`` end with what tells equal rows apart, so they can be divided."""
    spark, at = rows.sparkSession, "_rt_at"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialise(placed, "ranked")  # the upper bits are the range, the lower ones the place in it
    part, inside = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    total, before = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each range
        before.append((r["part"], total))
        total += r["count"]
    starts = spark.createDataFrame(before, "_rt_part long, _rt_before long")
    return placed.join(F.broadcast(starts), part == F.col("_rt_part")).withColumn(out, F.col("_rt_before") + inside + 1).select(*rows.columns, out)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
