"""Where to look closer: extreme pixels of frames, and patches for samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import BROADCAST_ROWS, written


def eroded(df: DataFrame, keys: list[str], invalid: str, distance: float) -> DataFrame:
    """Valid pixels that lie at least ``distance`` (Euclidean) from every
    invalid one of their frame; a null flag is invalid.

    First the distance along each column, by windows; then only pixels near an
    invalid one of their column reach out along their row, so a cloud costs its
    rim and not its area times the circle's."""
    rows = df.withColumn("_bad", F.coalesce(F.col(invalid), F.lit(True)))
    column = Window.partitionBy(*keys, "x").orderBy("y")
    bad_y = F.when(F.col("_bad"), F.col("y"))
    above = F.last(bad_y, True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(bad_y, True).over(column.rowsBetween(0, Window.unboundedFollowing))
    far = F.least(F.col("y") - above, below - F.col("y"))
    near = rows.select(*keys, "y", "x", far.alias("_d")).where(F.col("_d") < distance)
    reach = F.ceil(F.sqrt(F.lit(float(distance) ** 2) - F.col("_d") * F.col("_d"))).cast("int") - 1
    hit = near.select(*keys, "y", F.explode(F.sequence(F.col("x") - reach, F.col("x") + reach)).alias("x")).distinct()
    return rows.where("NOT _bad").drop("_bad").join(hit, [*keys, "y", "x"], "left_anti")


def frame_extremes(df: DataFrame, keys: list[str], value: str, invalid: str, height: int, width: int, separation: float = 10, chip: int = 10, top: int = 10) -> DataFrame:
    """The ``top`` highest and lowest of all frames' highest and lowest pixels:
    ``keys, y, x``, the value, ``side`` (``high`` or ``low``) and ``rank``.

    Only pixels count that are valid and finite, lie ``separation`` (and half a
    ``chip``) from any that isn't, and as far from the frame's edges. Of equal
    values in a frame the first by row and column is taken, of equal frames the
    first by ``keys``; a pixel that is both the highest and the lowest of its
    frame counts once a side. Frames without such a pixel are left out."""
    v = F.col(value).cast("double")
    odd = F.coalesce(F.col(invalid), F.lit(True)) | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = df.select(*keys, "y", "x", v.alias(value), odd.alias("_odd"))
    margin = max(int(separation), chip // 2)
    clear = eroded(rows, keys, "_odd", max(float(separation), chip // 2))
    clear = clear.where(F.col("y").between(margin, height - margin - 1) & F.col("x").between(margin, width - margin - 1))
    best = clear.groupBy(*keys).agg(
        F.max(F.struct(F.col(value), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("hi"), F.min(F.struct(value, "y", "x")).alias("lo")
    )
    ends = F.array(F.struct((-F.col("hi.y")).alias("y"), (-F.col("hi.x")).alias("x"), F.col(f"hi.{value}").alias(value)), F.struct(F.col("lo.y").alias("y"), F.col("lo.x").alias("x"), F.col(f"lo.{value}").alias(value)))
    found = written(best.select(*keys, F.inline(ends)).distinct())
    sides = []
    for side, order in (("high", F.desc(value)), ("low", F.asc(value))):
        order = [order, *map(F.asc, keys), F.asc("y"), F.asc("x")]
        few = found.orderBy(*order).limit(top)  # so the window has at most ``top`` rows
        sides.append(few.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def draw_places(df: DataFrame, stratum: str, each: int, seed: int, where: str = "true") -> DataFrame:
    """``stratum, y, x, patch``: ``each`` places of every stratum (all, if it has
    fewer), those of the smallest hash of seed, row and column; ``patch`` counts
    them from 1. Null is a stratum. Only rows of ``where`` are drawn.

    Strata are counted first, and only rows whose hash may be among the
    smallest are ranked, so a stratum that holds a third of the raster sends
    few rows to its task."""
    hash = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "y", "x"), 256), 1, 12), 16, 10).cast("long")
    rows = df.where(where).select(stratum, "y", "x", hash.alias("_h"))
    counts = written(rows.groupBy(stratum).agg(F.count("*").alias("_n")))
    side = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    # the share of hashes that holds the ``each`` smallest but for one case in a billion
    enough = (each + 8 * each**0.5 + 40) / F.col("_n") * float(1 << 48)
    same = rows[stratum].eqNullSafe(side[stratum])
    few = rows.join(side, same).where(F.col("_h") < enough).select(rows[stratum], "y", "x", "_h")
    order = Window.partitionBy(stratum).orderBy("_h", "y", "x")
    return few.withColumn("patch", F.row_number().over(order)).where(F.col("patch") <= each).drop("_h")


def patches(pixels: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """Pixels of squares of ``size`` whose first corner is a place: the columns
    of ``places`` with ``dy, dx`` (from 0) and those of ``pixels`` but its place.
    Pixels are dealt by tiles of the squares' size; a square looks into the four
    tiles that it may touch. What lies outside the raster is missing."""
    tile = lambda c: F.floor(F.col(c) / size)
    near = lambda c: F.explode(F.sequence(tile(c), tile(c) + 1))
    names = [c for c in pixels.columns if c not in ("y", "x")]
    asked = places.withColumnsRenamed({"y": "_y0", "x": "_x0"}).withColumn("_ty", near("_y0")).withColumn("_tx", near("_x0"))
    dealt = pixels.withColumn("_ty", tile("y")).withColumn("_tx", tile("x"))
    inside = F.col("y").between(F.col("_y0"), F.col("_y0") + size - 1) & F.col("x").between(F.col("_x0"), F.col("_x0") + size - 1)
    kept = [F.col("_y0").alias("y") if c == "y" else F.col("_x0").alias("x") if c == "x" else F.col(c) for c in places.columns]
    return asked.join(dealt, ["_ty", "_tx"]).where(inside).select(*kept, (F.col("y") - F.col("_y0")).alias("dy"), (F.col("x") - F.col("_x0")).alias("dx"), *names)
