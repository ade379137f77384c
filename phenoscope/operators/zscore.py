"""Standardisation in log space, and over spatial windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows
from ._tables import with_group


def log_zscore(df: DataFrame, value: str, keys: list[str], valid: Column | None = None, least: int = 1, score: str = "valid", out: str = "z", strict: bool = False) -> DataFrame:
    """``(ln v - mean) / sd`` over the rows of ``keys`` that are valid and
    positive (sd with n - 1). Null where fewer than ``least`` rows take part or
    they are all equal; ``strict`` raises on the latter. ``score='positive'``
    also scores positive rows that are not valid, ``score='all'`` every row: the
    logarithm of 0 is -inf, that of less NaN. The statistics are sums before
    the shuffle, so a key may hold any share of the rows; sums of doubles drift
    with their number and order, so rough scores are standardised once more by
    exact sums."""
    positive = F.coalesce(F.col(value) > 0, F.lit(False))
    used = positive if valid is None else positive & F.coalesce(valid, F.lit(False))
    # ln of a non-positive value must never be asked for
    log = F.ln(F.when(positive, F.col(value)))
    counted = F.when(used, log)
    rough = df.groupBy(*keys).agg(F.avg(counted).alias("_mean"), F.stddev_samp(counted).alias("_sd"), F.count(counted).alias("_n"))
    mean, sd, n = F.col("_mean"), F.col("_sd"), F.col("_n")
    near = lambda x: (x - mean) / F.nullif(sd, F.lit(0.0))
    exact = lambda x: F.sum(x.try_cast("decimal(38,20)")).cast("double")
    rest = [exact(near(counted)).alias("_off"), exact(near(counted) * near(counted)).alias("_square")]
    stats = with_group(df, rough, keys).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_mean", "_sd", "_n")], *rest)
    # what is left of mean and sd; none where infinite values allow no sums
    off, square = F.coalesce(F.col("_off") / n, F.lit(0.0)), F.coalesce(F.col("_square"), n - 1)
    spread = F.sqrt((square - n * off * off) / F.nullif(n - 1, F.lit(0)))
    endless = F.when(F.col(value) == 0, F.lit(float("-inf"))).when(F.col(value) < 0, F.lit(float("nan")))
    scored = {"positive": log, "all": F.coalesce(log, endless)}.get(score, counted)
    flat = F.raise_error(F.lit("constant group")).cast("double") if strict else F.lit(None).cast("double")
    z = F.when((n >= max(least, 2)) & (sd == 0), flat).otherwise((near(scored) - off) / spread)
    return with_group(df, stats, keys).withColumn(out, F.when(n >= least, z)).drop("_mean", "_sd", "_n", "_off", "_square")


def interval_coverage(df: DataFrame, keys: list[str], z: str, bound: float = 1.645) -> DataFrame:
    """Share of scores within ``bound``."""
    return df.where(F.col(z).isNotNull()).groupBy(*keys).agg(F.avg((F.abs(z) <= bound).cast("double")).alias("coverage"))


def local_zscore(df: DataFrame, value: str, size: int, stride: int, height: int, width: int, keys: list[str] | None = None, band_rows: int = windows.BAND_ROWS) -> DataFrame:
    """Per pixel of each frame (``keys``): the mean, over the windows that cover
    it, of its z-score in the window (sd with n, at least two values; 0 where they
    are all equal)."""
    rows = df.withColumn(value, F.col(value).cast("double"))
    return windows.by_pixel(rows, keys or [], value, "z", size, stride, height, width, windows.standardised(size), band_rows)


def annular_zscore(df: DataFrame, value: str, size: int, guard: int, stride: int, height: int, width: int, keys: list[str] | None = None, band_rows: int = windows.BAND_ROWS) -> DataFrame:
    """Like ``local_zscore``, but the statistics come from the ring outside the
    guard box (five pixels at least, sd above 1e-6), and only pixels inside the
    guard box are scored."""
    rows = df.withColumn(value, F.col(value).cast("double"))
    return windows.by_pixel(rows, keys or [], value, "z", size, stride, height, width, windows.standardised(size, guard, 5), band_rows)
