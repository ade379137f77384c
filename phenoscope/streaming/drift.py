"""Detectors on unbounded sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import Drift


def drift_stream(df: DataFrame, key: str, time: str, id: str, score: str, delay: str = "1 day", detector: Drift | None = None) -> DataFrame:
    """``key, id, status`` of every scored observation, with one row of state a
    key. Rows are taken in event time within a batch; those that arrive behind
    the watermark are dropped."""
    detector = detector or Drift()
    types = dict(df.dtypes)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values([time, id], kind="stable")
        now, out = (state.get if state.exists else Drift.START), []
        for s in pdf[score]:
            ok = pd.notna(s)
            now, status = detector.step(tuple(now), float(s) if ok else 0.0, bool(ok))
            out.append(status)
        state.update(now)
        yield pd.DataFrame({key: group[0], id: pdf[id].to_numpy(), "status": out})

    rows = df.select(key, F.col(time).cast("timestamp").alias(time), id, score).withWatermark(time, delay)
    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} {types[key]}, {id} {types[id]}, status int", "mean double, std double, counter int, steps int", "append", GroupStateTimeout.NoTimeout
    )


def cusum_stream(df: DataFrame, key: str, time: str, id: str, distance: str, reference: float, slack: float = 0.5, limit: float = 5.0, delay: str = "1 day") -> DataFrame:
    """Running ``S = max(0, S + d - reference - slack)`` of each key and
    whether it exceeds ``limit``."""
    types = dict(df.dtypes)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values([time, id], kind="stable")
        s, out = (state.get[0] if state.exists else 0.0), []
        for d in pdf[distance]:
            s = max(0.0, s + d - reference - slack) if pd.notna(d) else s
            out.append(s)
        state.update((s,))
        yield pd.DataFrame({key: group[0], id: pdf[id].to_numpy(), "cusum": out, "beyond": [v > limit for v in out]})

    rows = df.select(key, F.col(time).cast("timestamp").alias(time), id, distance).withWatermark(time, delay)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {id} {types[id]}, cusum double, beyond boolean", "s double", "append", GroupStateTimeout.NoTimeout)


def pass_stream(df: DataFrame, key: str, time: str, gap: str = "60 seconds", delay: str = "1 hour") -> DataFrame:
    """Passes of each key: sessions whose observations are at most ``gap``
    apart."""
    rows = df.select(key, F.col(time).cast("timestamp").alias(time)).withWatermark(time, delay)
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")
