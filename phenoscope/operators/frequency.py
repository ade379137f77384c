"""Spectra of unevenly sampled series by sums over rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import with_group


def spectrum(df: DataFrame, keys: list[str], t: str, y: str, freqs: list[float]) -> DataFrame:
    """``k`` (from 1) and ``amp`` of the centred series at each frequency. The
    grid is exploded per row and summed before the shuffle, so the shuffle
    carries one row a key, frequency and task."""
    means = df.groupBy(*keys).agg(F.avg(y).alias("_mean"))
    centred = with_group(df.select(*keys, t, y), means, keys).select(*keys, t, (F.col(y) - F.col("_mean")).alias("_v"))
    grid = F.posexplode(F.array(*[F.lit(f) for f in freqs])).alias("_k", "_f")
    rows = centred.select(*keys, t, "_v", grid)
    angle = 2 * math.pi * F.col("_f") * F.col(t)
    re, im = F.sum(F.col("_v") * F.cos(angle)), F.sum(F.col("_v") * F.sin(angle))
    return rows.groupBy(*keys, (F.col("_k") + 1).alias("k")).agg(F.sqrt(re * re + im * im).alias("amp"))


def integer_spectrum(df: DataFrame, keys: list[str], phase: str, y: str, bins: int) -> DataFrame:
    """Amplitudes at whole frequencies ``0 .. bins - 1`` of times in [-pi, pi]."""
    rows = df.select(*keys, phase, y, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("k"))
    re, im = F.sum(F.col(y) * F.cos(F.col("k") * F.col(phase))), F.sum(F.col(y) * F.sin(F.col("k") * F.col(phase)))
    return rows.groupBy(*keys, "k").agg(F.sqrt(re * re + im * im).alias("amp"))
