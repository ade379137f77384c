"""Small tables beside large ones."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of statistics that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def ensure_checkpoints(df: DataFrame) -> None:
    """Checkpoints go to ``spark.checkpoint.dir`` of the session; a temporary
    folder serves local sessions where it is unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="phenoscope-"))


def with_group(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``stats``, which has one row a key (null keys
    included). Few keys are broadcast, so no key gathers its rows in a task."""
    stats = written(stats)
    if not keys:
        return df.join(F.broadcast(stats))  # one row
    side = stats.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if stats.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(side[f"_k_{k}"]) for k in keys))
    return df.join(side, same).drop(*[f"_k_{k}" for k in keys])


def scratch(df: DataFrame, name: str) -> str:
    """A new path where checkpoints go."""
    ensure_checkpoints(df)
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet where checkpoints go, and read back: its
    lineage is cut and lost executors cost nothing. ``checkpoint()`` would
    compute it twice."""
    spark, path = df.sparkSession, scratch(df, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
