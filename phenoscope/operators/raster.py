"""Rasters as rows ``(y, x, value)``: stretches, dilation, mosaics, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows


def stretch(df: DataFrame, keys: list[str], value: str, low: float, high: float, gamma: float = 1.0, out: str = "stretched") -> DataFrame:
    """Percentile stretch of each frame to 0..255 with a gamma, truncated; null
    where the frame is flat."""
    pct = df.groupBy(*keys).agg(F.percentile(value, F.lit(low / 100)).alias("_lo"), F.percentile(value, F.lit(high / 100)).alias("_hi"))
    rows = df.join(pct, keys) if keys else df.crossJoin(F.broadcast(pct))  # one row
    share = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    gray = 255 * F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(1 / gamma))
    return rows.withColumn(out, F.when(share.isNotNull(), gray.cast("int"))).drop("_lo", "_hi")


def normalise(df: DataFrame, keys: list[str], value: str, log: bool = False, out: str = "n") -> DataFrame:
    """Range of each frame to [0, 1], linearly or by ``log(1 + v - min)``."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row
    span, at = F.col("_hi") - F.col("_lo"), F.col(value) - F.col("_lo")
    share = F.ln(1 + at) / F.nullif(F.ln(1 + span), F.lit(0.0)) if log else at / F.nullif(span, F.lit(0.0))
    return rows.withColumn(out, share).drop("_lo", "_hi")


def dilate(df: DataFrame, keys: list[str], flag: str, times: int, out: str = "dilated") -> DataFrame:
    """Spreads ``flag`` to all pixels within ``times`` steps (3x3 box); what
    lies outside counts as unset. Only set pixels are spread."""
    step = F.explode(F.sequence(F.lit(-times), F.lit(times)))
    hits = df.where(F.col(flag)).select(*keys, "y", "x", step.alias("_dy")).select(*keys, "y", "x", "_dy", step.alias("_dx"))
    hits = hits.select(*keys, (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x")).distinct()
    hits = hits.withColumn("_hit", F.lit(True))
    return df.join(hits, [*keys, "y", "x"], "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def clear_of(df: DataFrame, invalid: str, distance: float) -> DataFrame:
    """Valid pixels at least ``distance`` (Euclidean) from any invalid one."""
    r = int(distance)
    near = df.where(F.col(invalid)).select("y", "x")
    steps = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    spread = near.select("y", "x", steps.alias("dy")).select("y", "x", "dy", steps.alias("dx"))
    hit = spread.where(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") < distance * distance)
    hit = hit.select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    return df.where(~F.col(invalid)).join(hit, ["y", "x"], "left_anti")


def persistent(df: DataFrame, keys: list[str], flag: Column, seen: Column, share: float) -> DataFrame:
    """Pixels flagged in at least ``share`` of the largest number of flags that
    any pixel has; pixels never seen are not."""
    sums = df.groupBy(*keys).agg(F.count_if(seen & flag).alias("n_flag"), F.count_if(seen).alias("n_seen"))
    top = F.broadcast(sums.agg(F.max("n_flag").alias("top")))  # one row
    return sums.join(top).withColumn("persistent", (F.col("n_seen") > 0) & (F.col("n_flag") >= share * F.col("top"))).drop("top")


def mosaic(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value that isn't null wins."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(best.alias("_m")).select(*keys, F.col("_m")["_v"].alias(value))


def mosaic_mask(df: DataFrame, keys: list[str], mask: str, fill: int) -> DataFrame:
    """Clear beats flagged; the fill value loses to both."""
    return df.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(mask) != fill, F.col(mask))), F.lit(fill)).alias(mask))


def to_pixel(coordinate: Column, origin: float, step: float) -> Column:
    """Column or row of a coordinate, rounded half to even."""
    return F.rint((coordinate - origin) / step).cast("int")


def to_coordinate(index: Column, origin: float, step: float) -> Column:
    return origin + (index + 0.5) * step


def box_mean(df: DataFrame, value: str, size: int, height: int, width: int) -> DataFrame:
    """Mean over the ``size`` x ``size`` windows (stride 1) that cover each
    pixel of the windows' means: two passes of running sums over a dense grid,
    no row is multiplied. A window with a null has no mean."""
    row = Window.partitionBy("y").orderBy("x").rowsBetween(-(size - 1), 0)
    column = Window.partitionBy("x").orderBy("y").rowsBetween(-(size - 1), 0)
    sums = df.select("y", "x", F.sum(value).over(row).alias("s"), F.count(value).over(row).alias("n"))
    sums = sums.select("y", "x", F.sum("s").over(column).alias("s"), F.sum("n").over(column).alias("n"))
    whole = (F.col("n") == size * size) & (F.col("x") >= size - 1) & (F.col("y") >= size - 1)
    means = sums.select("y", "x", F.when(whole, F.col("s") / (size * size)).alias("m"))
    ahead_row = Window.partitionBy("y").orderBy("x").rowsBetween(0, size - 1)
    ahead_column = Window.partitionBy("x").orderBy("y").rowsBetween(0, size - 1)
    back = means.select("y", "x", F.sum("m").over(ahead_row).alias("m"), F.count("m").over(ahead_row).alias("c"))
    back = back.select("y", "x", F.sum("m").over(ahead_column).alias("m"), F.sum("c").over(ahead_column).alias("c"))
    return back.select("y", "x", (F.col("m") / F.nullif(F.col("c"), F.lit(0))).alias("mean"))


def mean_spectral_distance(df: DataFrame, spectrum: str, size: int, stride: int, height: int, width: int, keys: list[str] | None = None, band_rows: int = windows.SPECTRAL_ROWS) -> DataFrame:
    """Per pixel of each frame (``keys``): the mean, over the windows that cover
    it, of the windows' mean Euclidean distance to their mean spectrum. Spectra
    that are null or hold a null or NaN take no part."""
    rows = df.where(~F.exists(spectrum, lambda v: v.isNull() | F.isnan(v)))
    return windows.by_pixel(rows, keys or [], spectrum, "msd", size, stride, height, width, windows.spectral_distance, band_rows)


def best_window(df: DataFrame, value: str, clear: Column, size: int, stride: int, height: int, width: int, least: float) -> DataFrame:
    """The window with the largest clear share, then variance; the first one
    of equals. Windows below ``least`` are left out."""
    w = windows.clear_windows(df, [], value, clear, size, stride, height, width)
    w = w.select("wy", "wx", (F.col("clear") / F.lit(size * size)).alias("share"), F.round("variance", 6).alias("variance"))
    return w.where(F.col("share") >= least).orderBy(F.desc("share"), F.desc("variance"), "wy", "wx").limit(1)
