"""The relations of the data model, and a facade over a cube's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import candidates, complexity, raster, series, zscore

#: DDL of each relation. Fill values and NaN become null at the scan, flags
#: are widened to signed integers, and ``invalid`` is true for masked pixels.
SCHEMAS = {
    "pixels": "grid string, frame_idx int, y int, x int, spectrum array<float>, invalid boolean",
    "frames": "frame_idx int, ts timestamp, grid string, spacecraft string, local_idx int",
    "metrics": "frame_idx int, y int, x int, invalid boolean, volume double, z_frame double, z_sensor double, z_pixel double",
    "frame_stats": "frame_idx int, endmembers array<array<float>>, em_idx array<int>, volumes array<double>",
    "qa": "frame_idx int, y int, x int, fmask smallint, qa int, aerosol int, saturation int",
    "angles": "frame_idx int, y int, x int, angles struct<sza: float, saa: float, vza: float, vaa: float>",
    "display": "frame_idx int, y int, x int, rgba struct<r: smallint, g: smallint, b: smallint, a: smallint>",
    "series": "y int, x int, ts timestamp, t_frac double, v double, valid boolean",
    "embeddings": "y int, x int, window_idx int, ts timestamp, embedding array<float>",
    "results": "y int, x int, ts timestamp, predicted double, bound double, anomaly boolean, streak int, change_ts timestamp, change_count int",
    "drift": "y int, x int, ts timestamp, score double, status tinyint",
    "scenes": "scene_id string, lon_min double, lat_min double, lon_max double, lat_max double, ts timestamp, cloud_cover double",
    "swath": "lat double, lon double, ts timestamp, spectrum array<float>",
}


def clean(df: DataFrame, column: str, fills: tuple[float, ...] = (-9999.0, 255.0, 40000.0)) -> DataFrame:
    """Fill values and NaN to null."""
    v = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return df.withColumn(column, F.when(~v.isin(*fills), v))


class Cube:
    """Pixels (``frame_idx, y, x, spectrum, invalid``) and frames (``frame_idx,
    ts, spacecraft``) of one grid; every method returns a DataFrame."""

    def __init__(self, pixels: DataFrame, frames: DataFrame, height: int, width: int):
        self.pixels, self.frames, self.height, self.width = pixels, frames, height, width

    def pixel(self, y: int, x: int) -> DataFrame:
        """A pixel's series; the filter reaches the scan."""
        rows = self.pixels.where((F.col("y") == y) & (F.col("x") == x))
        return series.chronological(rows.join(self.frames, "frame_idx"), ["y", "x"], ["ts", "frame_idx"])

    def frame(self, idx: int) -> DataFrame:
        return self.pixels.where(F.col("frame_idx") == idx)

    def masked(self) -> DataFrame:
        return self.pixels.withColumn("spectrum", F.when(~F.col("invalid"), F.col("spectrum")))

    def dilated(self, times: int) -> Cube:
        rows = raster.dilate(self.pixels, ["frame_idx"], "invalid", times, "_d").withColumn("invalid", F.col("_d")).drop("_d")
        return Cube(rows, self.frames, self.height, self.width)

    def complexity(self, size: int = 3, stride: int = 1, count: int = 7, **options) -> DataFrame:
        """``frame_idx, y, x, complexity``."""
        return complexity.sliding_complexity(self.masked(), ["frame_idx"], "spectrum", size, stride, count, self.height, self.width, **options)

    def standardised(self, **options) -> DataFrame:
        """Complexity with its z-scores per frame, per sensor and per pixel."""
        rows = self.complexity(**options).join(self.frames, "frame_idx")
        rows = zscore.log_zscore(rows, "complexity", ["frame_idx"], out="z_frame")
        rows = zscore.log_zscore(rows, "complexity", ["spacecraft"], out="z_sensor")
        return zscore.log_zscore(rows, "complexity", ["spacecraft", "y", "x"], least=2, out="z_pixel")

    def extremes(self, top: int = 10, separation: float = 10, chip: int = 10, **options) -> DataFrame:
        """The frames and places of the highest and lowest complexity."""
        v = self.complexity(**options)
        rows = self.pixels.select("frame_idx", "y", "x", "invalid").join(v, ["frame_idx", "y", "x"], "left")
        return candidates.frame_extremes(rows, ["frame_idx"], "complexity", "invalid", self.height, self.width, separation, chip, top)
