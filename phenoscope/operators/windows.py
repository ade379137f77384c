"""Statistics of square windows without a copy of each pixel for each window.

A frame is dealt into bands of window origins, each with the rows that its
windows reach into: pixels are copied at the seams only, and no task holds a
frame. Inside a band a place of the windows (so many rows and columns from their
origins) is one strided view of the band, so a sum over windows is a sum of views.
What windows give back to their pixels is added up band by band, then by pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Window origins along y that a task takes at once, in strides; fewer of spectra.
BAND_ROWS, SPECTRAL_ROWS = 64, 16


class Band:
    """Pixels of a band: ``cube (rows, width, values)``, where it is known
    (``ok``), its first row (``top``) and the places of its windows."""

    def __init__(self, pdf: pd.DataFrame, value: str, size: int, stride: int, height: int, width: int, band_rows: int):
        self.top, self.size, self.stride = int(pdf["_band"].iloc[0]) * band_rows * stride, size, stride
        tall = min(height - self.top, (band_rows - 1) * stride + size)
        yy, xx = pdf["y"].to_numpy() - self.top, pdf["x"].to_numpy()
        inside = (yy < tall) & (xx >= 0) & (xx < width)
        self.empty = tall < size or width < size or not inside.any()
        if self.empty:
            return
        values = np.array(pdf[value][inside].tolist(), float).reshape(int(inside.sum()), -1)
        self.cube, self.ok = np.zeros((tall, width, values.shape[1])), np.zeros((tall, width), bool)
        self.cube[yy[inside], xx[inside]] = values
        self.ok[yy[inside], xx[inside]] = True
        self.windows = ((tall - size) // stride + 1, (width - size) // stride + 1)

    def places(self, used: np.ndarray | None = None) -> Iterable[tuple[slice, slice]]:
        """For each place of a window (or those set in ``used``), where all
        windows have it."""
        rows, cols = [(n - 1) * self.stride + 1 for n in self.windows]
        for dy, dx in np.argwhere(np.ones((self.size, self.size), bool) if used is None else used):
            yield slice(dy, dy + rows, self.stride), slice(dx, dx + cols, self.stride)

    def moments(self, v: np.ndarray, ok: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, mean and variance (over n) of the known values of each window;
        squares are taken about the window's own mean."""
        n, total, square = np.zeros(self.windows), np.zeros(self.windows), np.zeros(self.windows)
        for at in self.places(used):
            n += ok[at]
            total += np.where(ok[at], v[at], 0.0)
        mean = total / np.maximum(n, 1)
        for at in self.places(used):
            square += np.where(ok[at], v[at] - mean, 0.0) ** 2
        return n, mean, square / np.maximum(n, 1)


def bands(df: DataFrame, size: int, stride: int, height: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """``df`` with ``_band``; rows near a seam are in both of its bands."""
    step, last = band_rows * stride, (height - size) // stride * stride
    low = F.greatest(F.lit(0), F.floor((F.col("y") - size + 1) / step).cast("int"))
    high = F.least(F.floor(F.col("y") / step).cast("int"), F.lit(last // step))
    inside = F.col("y").between(0, height - 1) & (low <= high)
    return df.select("*", F.explode(F.when(inside, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("_band"))


def _key_types(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def by_pixel(df: DataFrame, keys: list[str], value: str, out: str, size: int, stride: int, height: int, width: int, work: Callable[[Band], tuple[np.ndarray, np.ndarray]], band_rows: int = BAND_ROWS) -> DataFrame:
    """``keys, y, x, out``: the mean of what windows give each pixel. ``work``
    returns totals and counts for the pixels of a band. Rows with a null value
    take no part; pixels that no window counts give no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band = Band(pdf, value, size, stride, height, width, band_rows)
        if band.empty:
            return pdf.iloc[:0][keys].assign(y=np.int32(0), x=np.int32(0), total=0.0, n=np.int64(0))
        total, n = work(band)
        y, x = np.nonzero(n)
        found = pdf.iloc[[0] * len(y)][keys].reset_index(drop=True)
        return found.assign(y=(y + band.top).astype(np.int32), x=x.astype(np.int32), total=total[y, x], n=n[y, x].astype(np.int64))

    rows = bands(df.where(F.col(value).isNotNull()).select(*keys, "y", "x", value), size, stride, height, band_rows)
    parts = rows.groupBy(*keys, "_band").applyInPandas(run, _key_types(df, keys) + "y int, x int, total double, n long")
    return parts.groupBy(*keys, "y", "x").agg((F.sum("total") / F.sum("n")).alias(out))


def standardised(size: int, guard: int | None = None, least: int = 2) -> Callable[[Band], tuple[np.ndarray, np.ndarray]]:
    """Sums of the pixels' z-scores in their windows. Without ``guard`` flat
    windows (sd up to 1e-12) give 0; with it the moments are those of the ring
    around the guard box, which alone is scored, and nearly flat rings (sd up to
    1e-6) give nothing."""
    box = None
    if guard is not None:
        far = np.abs(np.arange(size) - size // 2)
        box = np.maximum(far[:, None], far) <= guard // 2

    def work(band: Band) -> tuple[np.ndarray, np.ndarray]:
        v = band.cube[..., 0]
        n, mean, variance = band.moments(v, band.ok, None if box is None else ~box)
        sd, total, count = np.sqrt(variance), np.zeros(v.shape), np.zeros(v.shape, np.int64)
        good = (n >= least) & (True if box is None else sd > 1e-6)
        spread = np.where(sd > 1e-12, sd, np.inf)
        for at in band.places(box):
            use = good & band.ok[at]
            total[at] += np.where(use, (v[at] - mean) / spread, 0.0)
            count[at] += use
        return total, count

    return work


def spectral_distance(band: Band) -> tuple[np.ndarray, np.ndarray]:
    """Sums, over the windows of each pixel, of the windows' mean distance to
    their mean spectrum."""
    n, mean = np.zeros(band.windows), np.zeros((*band.windows, band.cube.shape[2]))
    for at in band.places():
        n += band.ok[at]
        mean += band.cube[at]  # unknown pixels are 0
    mean /= np.maximum(n, 1)[..., None]
    gap = np.zeros(band.windows)
    for at in band.places():
        gap += np.where(band.ok[at], np.sqrt(((band.cube[at] - mean) ** 2).sum(-1)), 0.0)
    gap /= np.maximum(n, 1)
    total, count = np.zeros(band.ok.shape), np.zeros(band.ok.shape, np.int64)
    for at in band.places():
        total[at] += np.where(band.ok[at], gap, 0.0)
        count[at] += band.ok[at]
    return total, count


def clear_windows(df: DataFrame, keys: list[str], value: str, clear: Column, size: int, stride: int, height: int, width: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """Windows that hold any pixel, by origin: ``keys, wy, wx, clear`` (their
    clear pixels) and ``variance`` (of the clear pixels' values that aren't
    null; 0 without any)."""
    flag = F.coalesce(clear, F.lit(False))
    known = flag & F.col(value).isNotNull()
    told = F.array(F.when(known, F.col(value).cast("double")).otherwise(0.0), flag.cast("double"), known.cast("double"))
    rows = bands(df.select(*keys, "y", "x", told.alias("_told")), size, stride, height, band_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band = Band(pdf, "_told", size, stride, height, width, band_rows)
        if band.empty:
            return pdf.iloc[:0][keys].assign(wy=np.int32(0), wx=np.int32(0), clear=np.int64(0), variance=0.0)
        held, flags = np.zeros(band.windows, np.int64), np.zeros(band.windows, np.int64)
        for at in band.places():
            held += band.ok[at]
            flags += band.cube[at][..., 1] > 0
        variance = band.moments(band.cube[..., 0], band.cube[..., 2] > 0)[2]
        j, i = np.nonzero(held)
        found = pdf.iloc[[0] * len(j)][keys].reset_index(drop=True)
        return found.assign(wy=(band.top + j * stride).astype(np.int32), wx=(i * stride).astype(np.int32), clear=flags[j, i], variance=variance[j, i])

    return rows.groupBy(*keys, "_band").applyInPandas(run, _key_types(df, keys) + "wy int, wx int, clear long, variance double")
