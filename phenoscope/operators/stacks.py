"""Scenes composed into stacks on one grid, and grids resampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins, series
from ._tables import with_group


def good_bands(scenes: DataFrame, good: str) -> DataFrame:
    """One row: ``bands``, whether each band is good in all scenes. As many
    entries as there are bands."""
    flags = scenes.select(F.posexplode(good).alias("band", "ok")).groupBy("band").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    return flags.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "ok"))), lambda s: s["ok"]).alias("bands"))


def sensor_stack(scenes: DataFrame, pixels: DataFrame, keys: list[str], gap_us: int, cells: int, least: float = 20.0, fill: int = 255, low: str = "drop", region: tuple[float, ...] | None = None) -> DataFrame:
    """Frames of a grid out of overlapping scenes.

    ``scenes``: ``keys``, ``scene``, ``us``, ``epsg``, ``good`` (a flag for each
    band), and ``x0, y0, x1, y1`` where a ``region`` is given, which scenes must
    touch. ``pixels``: ``scene``, ``y``, ``x``, ``spectrum``, ``mask`` (0 clear,
    ``fill`` nothing). Scenes of one key at most ``gap_us`` after the one before
    are one pass; a pass is one frame, at its first scene's time. In a frame the
    latest spectrum that isn't null wins and clear beats flagged. Frames with
    clear pixels on less than ``least`` percent of ``cells`` are dropped, or
    kept with ``low='keep'``. Bands that are bad in any scene are left out.
    Scenes of different ``epsg`` raise; a null one counts as the others'.
    Repeated scene rows count once; scenes without pixels give no frame.
    """
    if region is not None:
        box = ("x0", "y0", "x1", "y1")
        scenes = scenes.where(joins.bbox_intersects(tuple(map(F.col, box)), tuple(map(F.lit, region))))
    facts = scenes.agg(F.min("epsg").alias("lo"), F.max("epsg").alias("hi")).join(F.broadcast(good_bands(scenes, "good")))  # one row each
    same = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("scenes on different grids")).cast("array<boolean>")).otherwise(F.col("bands"))
    passes = series.sessions(scenes.select(*keys, "scene", "us").distinct(), keys, "us", gap_us, ["us", "scene"])
    rows = pixels.join(passes, "scene")
    value = F.max(F.when(F.col("spectrum").isNotNull(), F.struct("us", "scene", "spectrum")))
    clear = F.coalesce(F.min(F.when(F.col("mask") != fill, F.col("mask"))), F.lit(fill))
    frame = [*keys, "session"]
    grid = rows.groupBy(*frame, "y", "x").agg(value.alias("_v"), clear.alias("mask"))
    grid = grid.select(*frame, "y", "x", F.col("_v.spectrum").alias("spectrum"), "mask")
    share = F.count_if((F.col("mask") == 0) & F.col("spectrum").isNotNull()) * 100.0 / cells
    frames = grid.groupBy(*frame).agg(share.alias("coverage"))
    frames = frames.join(passes.groupBy(*frame).agg(F.min("us").alias("frame_us")), frame)
    if low == "drop":
        frames = frames.where(F.col("coverage") >= least)
    out = grid.join(frames, frame).join(F.broadcast(facts.select(same.alias("_bands"))))  # one row
    kept = F.filter("spectrum", lambda v, i: F.coalesce(F.get("_bands", i), F.lit(False)))
    return out.select(*frame, "frame_us", "coverage", "y", "x", kept.alias("spectrum"), "mask")


def swath_stack(points: DataFrame, targets: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Swath chunks on a grid: for each chunk and target (``t_id, x, y``) the
    nearest point (``x, y, value``) within ``radius``, the smaller ``p_id`` of
    equals, then the value of the chunk latest in ``chunk`` order wins for each
    of ``keys``. Points without a value take no part."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    t = targets.select("t_id", F.col("x").alias("tx"), F.col("y").alias("ty"), near("x").alias("cx")).select("t_id", "tx", "ty", "cx", F.explode(F.sequence(F.floor(F.col("ty") / radius) - 1, F.floor(F.col("ty") / radius) + 1)).alias("cy"))
    p = points.where("value is not null").select(*keys, "chunk", "p_id", "x", "y", "value", cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")))
    found = t.join(p, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius)
    best = found.groupBy(*keys, "chunk", "t_id").agg(F.min(F.struct("d", "p_id", "value")).alias("m"))
    return best.groupBy(*keys, "t_id").agg(F.max_by("m.value", "chunk").alias("value"))


def _cubic(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)


def resample(df: DataFrame, value: str, targets: DataFrame, method: str = "bilinear") -> DataFrame:
    """``targets`` (``ty, tx`` and real ``y, x`` in source pixels) with the
    source's value there: ``bilinear`` (2 x 2 pixels) or ``cubic`` (4 x 4).
    Missing and null pixels take no part and the other weights are scaled up;
    targets none of whose pixels are known give no row."""
    reach = {"bilinear": 1, "cubic": 2}[method]
    weight = (lambda d: F.greatest(F.lit(0.0), 1 - F.abs(d))) if method == "bilinear" else _cubic
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c)).cast("int") - (reach - 1), F.floor(F.col(c)).cast("int") + reach))
    near = targets.select("ty", "tx", F.col("y").alias("_y"), F.col("x").alias("_x"), span("y").alias("y")).select("*", F.explode(F.sequence(F.floor("_x").cast("int") - (reach - 1), F.floor("_x").cast("int") + reach)).alias("x"))
    near = near.withColumn("_w", weight(F.col("y") - F.col("_y")) * weight(F.col("x") - F.col("_x"))).where("_w <> 0")
    both = near.join(df.select("y", "x", F.col(value).alias("_v")).where("_v is not null"), ["y", "x"])
    out = both.groupBy("ty", "tx").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"))
    return out.where(F.abs("_n") > 1e-9).select("ty", "tx", (F.col("_s") / F.col("_n")).alias(value))


def average(df: DataFrame, value: str, step: float) -> DataFrame:
    """Means over target cells of ``step`` source pixels; the centre of a pixel
    decides its cell, nulls take no part."""
    cell = lambda c: F.floor((F.col(c) + 0.5) / step).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(cell("y").alias("ty"), cell("x").alias("tx")).agg(F.avg(value).alias(value))


def colour_image(df: DataFrame, keys: list[str], bands: tuple[str, str, str], low: float = 2.0, high: float = 98.0, on_flat: str = "null") -> DataFrame:
    """Three bands, each stretched between its percentiles to [0, 1] (``red,
    green, blue``). A flat band is null, or raises with ``on_flat='raise'``."""
    pct = df.groupBy(*keys).agg(*[F.percentile(b, F.lit(p / 100)).alias(f"_{n}{i}") for i, b in enumerate(bands) for n, p in (("lo", low), ("hi", high))])
    rows = with_group(df, pct, keys)
    for i, (b, name) in enumerate(zip(bands, ("red", "green", "blue"))):
        span = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        flat = F.raise_error(F.lit("flat band")).cast("double") if on_flat == "raise" else F.lit(None).cast("double")
        share = F.when(span == 0, flat).otherwise((F.col(b) - F.col(f"_lo{i}")) / span)
        rows = rows.withColumn(name, F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))
    return rows.drop(*[f"_{n}{i}" for i in range(3) for n in ("lo", "hi")])
