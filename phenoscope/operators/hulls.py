"""Convex hulls of point sets that no task holds whole.

A point of a set's hull is on the hull of every part of the set that has it, so
each batch of rows gives its own hull, and hulls are merged in rounds: candidates
are dealt over fewer and fewer tasks until one is left for each key. What moves
is hull points only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import written

#: Hulls that one task merges.
FAN_IN = 16


def hull_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull, against the clock from the
    smallest (x, y). Points on an edge are no corners; of equal points the first
    counts; points on one line have its two ends."""
    order = np.lexsort((np.arange(len(x)), y, x))
    first = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]
    order = order[first]
    if len(order) < 3:
        return order

    def chain(places: np.ndarray) -> list[int]:
        kept: list[int] = []
        for p in places:
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                if (x[b] - x[a]) * (y[p] - y[a]) > (y[b] - y[a]) * (x[p] - x[a]):
                    break
                kept.pop()
            kept.append(int(p))
        return kept

    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1])


def _outer(x: np.ndarray, y: np.ndarray, directions: int = 32) -> np.ndarray:
    """Places that may be corners: all but those strictly inside the polygon of
    the farthest points in some directions. Leaves few points to the exact search."""
    if len(x) < 4 * directions:
        return np.arange(len(x))
    turn = np.linspace(0, 2 * np.pi, directions, endpoint=False)
    far = np.unique((np.cos(turn)[:, None] * x + np.sin(turn)[:, None] * y).argmax(1))
    ring = far[hull_places(x[far], y[far])]
    if len(ring) < 3:
        return np.arange(len(x))
    ax, ay, bx, by = x[ring], y[ring], np.roll(x[ring], -1), np.roll(y[ring], -1)
    side = (bx - ax)[:, None] * (y - ay[:, None]) - (by - ay)[:, None] * (x - ax[:, None])
    slack = 1e-9 * (np.ptp(x) + np.ptp(y)) ** 2
    return np.flatnonzero(~(side > slack).all(0))


def _corners(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of a frame ``_id, _x, _y`` that are corners of its hull."""
    pdf = pdf.sort_values("_id", kind="stable", ignore_index=True)
    x, y = pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float)
    may = _outer(x, y)
    return pdf.iloc[may[hull_places(x[may], y[may])]]


def convex_hulls(df: DataFrame, keys: list[str], id: str, x: str, y: str) -> DataFrame:
    """Corners of the hull of each key's points: ``keys, id, x, y, corner``,
    numbered from 0 against the clock, from the smallest ``(x, y)`` on.

    Rows with a null, NaN or infinite coordinate take no part; null keys are a
    key; of equal points the smallest id is told. Fewer than three different
    points, or points on one line, give their ends.
    """
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731  NaN is greater
    types = dict(df.dtypes)
    rows = df.where(finite(x) & finite(y)).select(*keys, F.col(id).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    kinds = "".join(f"`{k}` {types[k]}, " for k in keys) + f"_id {types[id]}, _x double, _y double"

    def of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if keys and len(pdf):
                yield from (_corners(part) for _, part in pdf.groupby(keys, dropna=False, sort=False))
            elif len(pdf):
                yield _corners(pdf)

    found = written(rows.mapInPandas(of_batch, kinds).select("*", F.spark_partition_id().alias("_part")))
    parts = found.agg(F.max("_part")).first()[0] or 0
    while parts > FAN_IN:
        parts //= FAN_IN
        dealt = found.withColumn("_part", F.floor(F.col("_part") / FAN_IN).cast("int"))
        found = written(dealt.groupBy(*keys, "_part").applyInPandas(_corners, kinds + ", _part int"))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _corners(pdf.drop(columns=["_part", "_all"]))
        return out.assign(corner=np.arange(len(out), dtype=np.int32))

    whole = found.withColumn("_all", F.lit(0)).groupBy(*(keys or ["_all"]))
    out = whole.applyInPandas(last, kinds + ", corner int")
    return out.select(*keys, F.col("_id").alias(id), F.col("_x").alias(x), F.col("_y").alias(y), "corner")
