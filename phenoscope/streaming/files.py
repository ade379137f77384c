"""Streams over landing folders: files taken in order, each row's result
appended once, state carried over restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.detect import Drift

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(df: DataFrame, folder: str, time: str, parts: int) -> None:
    """Writes ``df`` as ``parts`` drops of a landing folder, one after the other
    in order of ``time`` (equal times together; null times in the first)."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = df.select(F.percentile_approx(us, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    drop = sum(((us > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    marked = df.withColumn("_drop", F.coalesce(drop, F.lit(0)))
    for k in range(len(set(cuts)) + 1):
        marked.where(F.col("_drop") == k).drop("_drop").coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """The folder's files, ``files`` at a time, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(folder)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Works through all that has landed, appends each micro-batch once and
    stops; called again with the same ``checkpoint`` it takes what is new. The
    sink's log tells a batch that was written from one that is repeated, so a
    restart neither loses nor doubles rows. Returns what is appended so far."""
    schema = stream.schema
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)


class _DriftState(StatefulProcessor):
    """One value of state a key: what ``Drift.step`` goes on from."""

    def __init__(self, detector: Drift, names: list[str], time: str, id: str, score: str):
        self.detector, self.names, self.time, self.id, self.score = detector, names, time, id, score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drift", "mean double, std double, counter bigint, steps bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([self.time, self.id], kind="stable")
        now, out = (tuple(self.state.get()) if self.state.exists() else Drift.START), []
        for s in pdf[self.score]:
            ok = pd.notna(s)
            now, status = self.detector.step(now, float(s) if ok else 0.0, bool(ok))
            out.append(status)
        self.state.update((float(now[0]), float(now[1]), int(now[2]), int(now[3])))
        yield pd.DataFrame({self.names[0]: key[0], self.id: pdf[self.id].to_numpy(), "status": out})

    def close(self) -> None:
        pass


def drift_states(df: DataFrame, key: str, time: str, id: str, score: str, delay: str = "1 day", detector: Drift | None = None) -> DataFrame:
    """``key, id, status`` of each scored row of a stream; a null score is an
    invalid observation. Rows of a micro-batch are taken in order of ``time``
    and ``id``; those more than ``delay`` behind the latest time of the
    micro-batches before are late and left out."""
    types = dict(df.dtypes)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = df.select(key, F.col(time).cast("timestamp").alias(time), id, score).withWatermark(time, delay)
    # a watermark alone drops nothing before a state of one's own, so late rows are told here
    return rows.groupBy(key).transformWithStateInPandas(_DriftState(detector or Drift(), [key], time, id, score), f"{key} {types[key]}, {id} {types[id]}, status int", "Append", "EventTime")


def first_sight(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose ``keys`` and time have not been seen within ``delay``."""
    rows = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return rows.dropDuplicatesWithinWatermark(keys)


def hourly(df: DataFrame, time: str, value: Column, delay: str, width: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Count and sum of each window of ``width`` that the watermark has passed."""
    rows = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    out = rows.groupBy(*(keys or []), F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*(keys or []), F.col("w.start").alias("start"), "n", "total")
