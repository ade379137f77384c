"""Extreme spectra of frames of any size, one aggregate a step.

A spectrum's distance from the last one after projecting out orthonormal
directions ``u`` is ``|x - l|^2 - sum(((x - l) . u)^2)``, so a step needs only
the directions so far and the last spectrum of each frame, and the farthest
spectrum is a maximum that combines before the shuffle. Frames of at most
``WHOLE_ROWS`` spectra are searched whole in one task, which gives the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from ._tables import BROADCAST_ROWS, with_group, written

#: Spectra of a frame that one task takes whole.
WHOLE_ROWS = 20_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def _valid(df: DataFrame, keys: list[str], spectrum: str) -> DataFrame:
    rows = df.where(F.col(spectrum).isNotNull() & ~F.exists(spectrum, lambda v: v.isNull() | F.isnan(v)))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows


def clip_legacy(df: DataFrame, keys: list[str], spectrum: str) -> DataFrame:
    """Spectra without null or NaN, limited frame by frame: from 0 up if the
    frame holds a negative value, to 2 then; to 1 if any value exceeds 1."""
    rows = _valid(df, keys, spectrum).withColumn(spectrum, F.transform(spectrum, lambda v: v.cast("double")))
    ends = rows.groupBy(*keys).agg(F.min(F.array_min(spectrum)).alias("_low"), F.max(F.array_max(spectrum)).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    limited = lambda v: F.when(high > 1, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).when(low < 0, F.greatest(v, F.lit(0.0))).otherwise(v)
    return with_group(rows, ends, keys).withColumn(spectrum, F.transform(spectrum, limited)).drop("_low", "_high")


def extreme_sets(df: DataFrame, keys: list[str], id: str, spectrum: str, count: int, unit: bool = False, stop: float = kernels.TINY, hull: bool = False, whole: int | None = None) -> DataFrame:
    """Per frame (``keys``): ``picks`` (ids), ``ends`` (their spectra) and
    ``steps``, how many were found before the direction between the last two
    came to a squared length of ``stop``. Spectra with a null or NaN and rows
    with a null key are left out; frames with fewer than ``count`` spectra give
    no row; ties go to the smaller id, a number. ``unit`` scales the spectra to
    length one after the first two. ``hull`` starts with the longest alone and
    takes the farthest from the affine hull of those found; it ends where none
    is farther than ``stop`` (squared). ``whole``: see ``WHOLE_ROWS``."""
    x = F.transform(spectrum, lambda v: v.cast("double"))
    rows = _valid(df, keys, spectrum).select(*keys, F.col(id).cast("long").alias("_id"), x.alias("_x"))
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    whole = WHOLE_ROWS if whole is None else whole
    large = sizes.where(F.col("_n") > whole).drop("_n")
    if large.isEmpty():
        return _sets_whole(rows, keys, count, unit, stop, hull)
    small = sizes.where(F.col("_n") <= whole).drop("_n")
    few = sizes.count() <= BROADCAST_ROWS
    of = lambda side: rows.join(F.broadcast(side) if few else side, keys, "left_semi")
    return _sets_by_steps(of(large), keys, count, unit, stop, hull).unionByName(_sets_whole(of(small), keys, count, unit, stop, hull))


def _sets_whole(rows: DataFrame, keys: list[str], count: int, unit: bool, stop: float, hull: bool) -> DataFrame:
    """``extreme_sets`` of frames that fit one task."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        if len(pdf) < count:
            return pdf.iloc[:0][keys].assign(picks=None, ends=None, steps=np.int32(0))
        x = np.array(pdf["_x"].tolist(), float)
        at = kernels.farthest_from_hull(x, count, stop) if hull else kernels.max_distance(x[None], count, unit=unit)[0]
        ends = x[at]
        if unit:
            ends = ends / np.sqrt(np.maximum((ends**2).sum(1, keepdims=True), kernels.TINY))
        steps = len(at) if hull else kernels.steps_until(ends, stop)
        return pdf.iloc[:1][keys].assign(picks=[pdf["_id"].to_numpy()[at]], ends=[list(ends)], steps=np.int32(steps))

    types = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(pick, "".join(f"{k} {types[k]}, " for k in keys) + "picks array<long>, ends array<array<double>>, steps int")


def _sets_by_steps(rows: DataFrame, keys: list[str], count: int, unit: bool, stop: float, hull: bool) -> DataFrame:
    """``extreme_sets`` of frames of any size."""
    size = _dot(F.col("_x"), F.col("_x"))
    far, near = F.max(F.struct(size.alias("d"), (-F.col("_id")).alias("i"), "_x")), F.min(F.struct(size.alias("d"), F.col("_id").alias("i"), "_x"))
    both = rows.groupBy(*keys).agg(far.alias("a"), near.alias("b"), F.count("*").alias("n")).where(F.col("n") >= count)
    begun = 1 if hull else 2
    state = written(both.select(
        *keys, F.slice(F.array(-F.col("a.i"), F.col("b.i")), 1, begun).alias("picks"), F.slice(F.array("a._x", "b._x"), 1, begun).alias("ends"),
        F.array().cast("array<array<double>>").alias("dirs"), F.lit(begun).alias("steps"), F.lit(True).alias("open"),
    ))
    few = state.count() <= BROADCAST_ROWS
    if unit:
        scale = lambda v: F.transform(v, lambda c: c / F.sqrt(F.greatest(_dot(v, v), F.lit(kernels.TINY))))
        rows = rows.withColumn("_x", scale(F.col("_x")))
        state = state.withColumn("ends", F.transform("ends", scale))
    for _ in range(begun, count):
        way = _minus(F.element_at("ends", -1), F.element_at("ends", 1 if hull else -2))
        way = F.aggregate("dirs", way, lambda s, u: F.zip_with(s, F.transform(u, lambda c: c * _dot(s, u)), lambda p, q: p - q))
        state = state.withColumn("_way", way).withColumn("_norm", _dot(F.col("_way"), F.col("_way")))
        fresh = F.array(F.transform("_way", lambda c: c / F.sqrt(F.col("_norm"))))
        state = state.withColumn("dirs", F.when(F.col("_norm") > kernels.TINY, F.concat("dirs", fresh)).otherwise(F.col("dirs")))
        state = state.withColumn("open", F.col("open") & ((F.col("_norm") > stop) | F.lit(hull))).drop("_way", "_norm")
        side = state.select(*keys, F.col("dirs").alias("_dirs"), F.element_at("ends", 1 if hull else -1).alias("_from"))
        seen = rows.join(F.broadcast(side) if few else side, keys).withColumn("_gap", _minus(F.col("_x"), F.col("_from")))
        away = F.aggregate("_dirs", _dot(F.col("_gap"), F.col("_gap")), lambda s, u: s - _dot(F.col("_gap"), u) * _dot(F.col("_gap"), u))
        best = seen.groupBy(*keys).agg(F.max(F.struct(away.alias("d"), (-F.col("_id")).alias("i"), "_x")).alias("m"))
        more = (F.col("m.d") > stop) | F.lit(not hull)
        state = written(state.join(best, keys).select(
            *keys, F.when(more, F.concat("picks", F.array(-F.col("m.i")))).otherwise(F.col("picks")).alias("picks"),
            F.when(more, F.concat("ends", F.array("m._x"))).otherwise(F.col("ends")).alias("ends"),
            "dirs", (F.col("steps") + (F.col("open") & more).cast("int")).alias("steps"), "open",
        ))
    return state.select(*keys, F.slice("picks", 1, count).alias("picks"), F.slice("ends", 1, count).alias("ends"), F.least("steps", F.lit(count)).alias("steps"))


def extreme_spectra(df: DataFrame, keys: list[str], id: str, spectrum: str, count: int, unit: bool = False, hull: bool = False) -> DataFrame:
    """``rank`` (from 0) and ``id`` of each frame's extreme spectra."""
    return extreme_sets(df, keys, id, spectrum, count, unit, hull=hull).select(*keys, F.posexplode("picks").alias("rank", "id"))


def _means(df: DataFrame, keys: list[str], spectrum: str) -> DataFrame:
    bands = _valid(df, keys, spectrum).select(*keys, F.posexplode(spectrum).alias("band", "v"))
    bands = bands.groupBy(*keys, "band").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return bands.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "m"))), lambda s: s["m"]).alias("mean"))


def volume_curves(df: DataFrame, keys: list[str], id: str, spectrum: str, count: int, origin: str = "minEndmember", by_bands: bool = True, gram: bool = False) -> DataFrame:
    """Volumes of each frame's extreme spectra: ``m`` (from 1), ``volume``. Only
    the extreme spectra of a frame and its mean go to Python."""
    return localised_curves(df, keys, id, spectrum, count, [origin], by_bands, gram).drop("origin")


def localised_curves(df: DataFrame, keys: list[str], id: str, spectrum: str, count: int, origins: list[str], by_bands: bool = True, gram: bool = False) -> DataFrame:
    """``volume_curves`` for several choices of ``origin``; the extreme spectra
    are sought once."""
    sets = extreme_sets(df, keys, id, spectrum, count).select(*keys, "ends")
    sets = sets.join(_means(df, keys, spectrum), keys) if "datasetMean" in origins else sets.withColumn("mean", F.lit(None).cast("array<double>"))
    kernel = kernels.gram_curve if gram else kernels.volume_curve

    def curve(batches):
        for pdf in batches:
            for origin in origins:
                out = []
                for ends, mean in zip(pdf["ends"], pdf["mean"]):
                    e = np.array(list(map(list, ends)), float)[None]
                    v = kernels.volumes(e, origin, None if mean is None else np.array(mean, float)[None], kernel)[0]
                    out.append(v / e.shape[2] ** (np.arange(1, len(v) + 1) / 2) if by_bands else v)
                yield pdf[keys].assign(origin=origin, curve=out)

    types = dict(sets.dtypes)
    rows = sets.mapInPandas(curve, "".join(f"{k} {types[k]}, " for k in keys) + "origin string, curve array<double>")
    return rows.select(*keys, "origin", F.posexplode("curve").alias("_m", "volume")).select(*keys, "origin", (F.col("_m") + 1).cast("int").alias("m"), "volume")


def projected_volumes(df: DataFrame, keys: list[str], id: str, spectrum: str, count: int, stop: float = 1e-9) -> DataFrame:
    """Volumes spanned with the origin by each frame's first 2, 3, ... extreme
    spectra (``m``, ``volume``); 0 for one, and from where the direction
    between the last two is shorter than ``stop`` (squared)."""
    sets = extreme_sets(df, keys, id, spectrum, count, stop=stop)

    def curve(batches):
        for pdf in batches:
            out = []
            for ends, steps in zip(pdf["ends"], pdf["steps"]):
                v = kernels.gram_curve(np.array(list(map(list, ends)), float)[None])[0]
                m = np.arange(1, len(v) + 1)
                out.append(np.where((m > 1) & (m <= steps), v, 0.0))
            yield pd.DataFrame(pdf[keys]).assign(curve=out)

    types = dict(sets.dtypes)
    rows = sets.mapInPandas(curve, "".join(f"{k} {types[k]}, " for k in keys) + "curve array<double>")
    return rows.select(*keys, F.posexplode("curve").alias("_m", "volume")).select(*keys, (F.col("_m") + 1).cast("int").alias("m"), "volume")
