"""Spectral complexity of tiles, frames and sliding windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"{k} {types[k]}, " for k in keys)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def volume_curves(df: DataFrame, keys: list[str], id: str, spectrum: str, count: int, origin: str = "minEndmember", by_bands: bool = True, gram: bool = False) -> DataFrame:
    """Per tile the volumes of its extreme spectra: ``m`` (from 1), ``volume``. A
    tile is one group in one task; ``extremes`` takes frames of any size."""

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _stack(pdf.sort_values(id, kind="stable")[spectrum])[None]
        if x.shape[1] < count:
            return pdf.iloc[:0][keys].assign(m=np.int32(0), volume=0.0)
        ends = x[0][kernels.max_distance(x, count)[0]][None]
        v = kernels.volumes(ends, origin, x.mean(1), kernels.gram_curve if gram else kernels.volume_curve)[0]
        m = np.arange(1, len(v) + 1)
        if by_bands:
            v = v / x.shape[2] ** (m / 2)
        return pdf.iloc[[0] * len(v)][keys].reset_index(drop=True).assign(m=m.astype(np.int32), volume=v)

    rows = df.where(F.col(spectrum).isNotNull() & ~F.exists(spectrum, lambda v: v.isNull() | F.isnan(v)))
    return rows.select(*keys, id, spectrum).groupBy(*keys).applyInPandas(curve, _schema(df, keys) + "m int, volume double")


def tile_complexity(df: DataFrame, keys: list[str], spectrum: str, tile: int, count: int, strict: bool = True, **options) -> DataFrame:
    """Non-overlapping tiles of ``tile`` x ``tile`` pixels: ``ty, tx, value``.
    With ``strict`` a tile with an invalid pixel has no value; otherwise its
    valid pixels are used. Tiles with fewer than ``count`` pixels have none."""
    ty, tx = F.floor(F.col("y") / tile).cast("int"), F.floor(F.col("x") / tile).cast("int")
    bad = F.col(spectrum).isNull() | F.exists(spectrum, lambda v: v.isNull() | F.isnan(v))
    rows = df.select(*keys, ty.alias("ty"), tx.alias("tx"), "y", "x", spectrum, F.coalesce(bad, F.lit(True)).alias("bad"))
    if strict:  # decided before any pixel goes to Python
        whole = rows.groupBy(*keys, "ty", "tx").agg(F.bool_or("bad").alias("any")).where("not any").drop("any")
        rows = rows.join(whole, [*keys, "ty", "tx"], "left_semi")

    def value(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _stack(pdf.sort_values(["y", "x"])[spectrum])[None]
        v = float(kernels.complexity(x, count, **options)[0]) if x.shape[1] >= count else None
        return pdf.iloc[:1][[*keys, "ty", "tx"]].assign(value=v)

    return rows.where("not bad").groupBy(*keys, "ty", "tx").applyInPandas(value, _schema(df, keys) + "ty int, tx int, value double")


def sliding_complexity(df: DataFrame, keys: list[str], spectrum: str, size: int, stride: int, count: int, height: int, width: int, band_rows: int = 64, origin: str = "minEndmember", by_bands: bool = True, on_invalid: str = "skip") -> DataFrame:
    """Per pixel the mean complexity of the ``size`` x ``size`` windows that
    cover it; pixels under no valid window have none.

    A frame is dealt into bands of ``band_rows`` window origins; each band
    travels with the rows its last windows reach into, so no frame has to fit
    one task and pixels are copied only at the seams. ``on_invalid``: ``skip``
    leaves out windows with an invalid pixel; ``use_rest`` takes the valid
    pixels of windows that have at least ``count``.
    """
    step = band_rows * stride
    last_origin = (height - size) // stride * stride
    low = F.greatest(F.lit(0), F.floor((F.col("y") - size + 1) / step).cast("int"))
    high = F.least(F.floor(F.col("y") / step), F.lit(last_origin // step)).cast("int")
    bands = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    rows = df.select(*keys, "y", "x", spectrum, F.explode(bands).alias("_band"))

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["_band"].iloc[0])
        top = band * step
        tall = min(height - top, step - stride + size)
        good = pdf[spectrum].map(lambda v: v is not None and not np.isnan(np.asarray(v, float)).any()).to_numpy(bool)
        depth = len(pdf[spectrum].iloc[int(good.argmax())]) if good.any() else 0
        empty = pdf.iloc[:0][keys].assign(y=np.int32(0), x=np.int32(0), total=0.0, n=np.int64(0))
        if not depth or tall < size:
            return empty
        cube, ok = np.zeros((tall, width, depth)), np.zeros((tall, width), bool)
        yy, xx = pdf["y"].to_numpy() - top, pdf["x"].to_numpy()
        inside = good & (yy < tall)
        cube[yy[inside], xx[inside]] = _stack(pdf[spectrum][inside])
        ok[yy[inside], xx[inside]] = True
        view = np.lib.stride_tricks.sliding_window_view
        win = view(cube, (size, size), (0, 1))[::stride, ::stride]
        fine = view(ok, (size, size))[::stride, ::stride].reshape(-1, size * size)
        oy, ox = np.indices(win.shape[:2]).reshape(2, -1) * stride
        use = np.flatnonzero(fine.all(1) if on_invalid == "skip" else fine.sum(1) >= count)
        total, n = np.zeros((tall, width)), np.zeros((tall, width), np.int64)
        for k in range(0, len(use), 5000):
            at = use[k : k + 5000]
            x = np.moveaxis(win[oy[at] // stride, ox[at] // stride], 1, -1).reshape(len(at), size * size, depth)
            v = kernels.complexity(x, count, origin, by_bands, fine[at])
            for dy in range(size):
                for dx in range(size):
                    np.add.at(total, (oy[at] + dy, ox[at] + dx), v)
                    np.add.at(n, (oy[at] + dy, ox[at] + dx), 1)
        y, x = np.nonzero(n)
        out = pdf.iloc[[0] * len(y)][keys].reset_index(drop=True)
        return out.assign(y=(y + top).astype(np.int32), x=x.astype(np.int32), total=total[y, x], n=n[y, x])

    parts = rows.groupBy(*keys, "_band").applyInPandas(slide, _schema(df, keys) + "y int, x int, total double, n long")
    return parts.groupBy(*keys, "y", "x").agg((F.sum("total") / F.sum("n")).alias("complexity"))


def functional_complexity(df: DataFrame, keys: list[str], spectrum: str, low: float = 400.0, high: float = 2500.0) -> DataFrame:
    """Spread of the spectra of each key as functions of wavelength; the bands
    lie evenly between ``low`` and ``high``. The spline coefficients, scaled by
    their inner product, are fixed sums of the bands, so the spread is the sum
    of their variances: one aggregate, a key is no single task's work. Spectra
    that are null, hold a null or NaN, or differ in length from the most
    frequent one are left out; a key of one spectrum has 0."""
    valid = df.where(F.col(spectrum).isNotNull() & ~F.exists(spectrum, lambda v: v.isNull() | F.isnan(v)))
    length = valid.groupBy(F.size(spectrum).alias("n")).count().orderBy(F.desc("count"), "n").first()
    bands = length["n"] if length else 2
    waves = np.linspace(low, high, bands)
    gaps = np.gradient(waves)
    parts = [
        F.aggregate(F.zip_with(spectrum, F.array(*[F.lit(float(w)) for w in row]), lambda v, w: v.cast("double") * w), F.lit(0.0), lambda s, v: s + v)
        for row in kernels.functional_weights(waves, gaps / gaps.sum(), low=low, high=high)
    ]
    rows = valid.where(F.size(spectrum) == bands).select(*keys, *[c.alias(f"_f{i}") for i, c in enumerate(parts)])
    spread = sum((F.coalesce(F.var_samp(f"_f{i}"), F.lit(0.0)) for i in range(1, len(parts))), F.coalesce(F.var_samp("_f0"), F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.sqrt(spread).alias("value"))


def smoothed_spectra(df: DataFrame, id: str, spectrum: str, window: int = 15, degree: int = 3) -> DataFrame:
    """Gaps filled along the bands, then Savitzky-Golay, batch by batch."""

    def run(batches):
        for pdf in batches:
            rows = []
            for v in pdf[spectrum]:
                y = np.array([np.nan if a is None else a for a in v], float)
                at = np.arange(len(y))
                ok = ~np.isnan(y)
                y = np.interp(at, at[ok], y[ok]) if ok.any() else y
                rows.append(kernels.smooth(y, window, degree))
            yield pd.DataFrame({id: pdf[id], "smooth": rows})

    return df.select(id, spectrum).mapInPandas(run, f"{id} {dict(df.dtypes)[id]}, smooth array<double>")
