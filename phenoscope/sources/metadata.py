"""Metadata texts: grids, scenes, file names, pixel samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_parameters(text: Column) -> Column:
    """Upper left corner, zone and coordinate system out of a grid's
    structure text; southern zones are negative there."""
    number = r"(-?[0-9.]+)"
    pick = lambda p, t: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast(t)
    zone = pick(r"ZoneCode=(-?[0-9]+)", "int")
    return F.struct(
        pick(rf"UpperLeftPointMtrs=\({number},", "double").alias("ul_x"),
        pick(rf"UpperLeftPointMtrs=\(-?[0-9.]+,{number}\)", "double").alias("ul_y"),
        pick(r"XDim=([0-9]+)", "int").alias("cols"),
        pick(r"YDim=([0-9]+)", "int").alias("rows"),
        zone.alias("zone"),
        (F.when(zone < 0, 32700).otherwise(32600) + F.abs(zone)).alias("epsg"),
    )


def grid_text(name: str, columns: int, rows: int, upper_left: tuple[float, float], lower_right: tuple[float, float], zone: int) -> str:
    """The text that ``grid_parameters`` reads."""
    return (
        f'GROUP=GridStructure\n\tGridName="{name}"\n\tXDim={columns}\n\tYDim={rows}\n'
        f"\tUpperLeftPointMtrs=({upper_left[0]},{upper_left[1]})\n\tLowerRightMtrs=({lower_right[0]},{lower_right[1]})\n"
        f"\tZoneCode={zone}\nEND_GROUP=GridStructure\nEND\n"
    )


SCENE = "properties struct<level: string, epsg: int>, bands array<struct<nm: double>>"


def scene_record(text: Column) -> Column:
    """Level, coordinate system and bands of a scene; other levels than L1B
    raise."""
    r = F.from_json(text, SCENE)
    level = F.when(r["properties"]["level"] == "L1B", r["properties"]["level"]).otherwise(F.raise_error(F.concat(F.lit("not L1B: "), F.coalesce(r["properties"]["level"], F.lit("?")))).cast("string"))
    return F.struct(level.alias("level"), r["properties"]["epsg"].alias("epsg"), r["bands"].alias("bands"))


def paired_files(files: DataFrame, path: str) -> DataFrame:
    """Image files with the geometry file of the same stem, and their time."""
    stem = lambda ext: F.regexp_extract(path, rf"^(.*){ext}$", 1)
    images = files.where(F.col(path).endswith(".hsi")).select(stem(r"\.hsi").alias("stem"), F.col(path).alias("image"))
    geometry = files.where(F.col(path).endswith("_igm.dat")).select(stem(r"_igm\.dat").alias("stem"), F.col(path).alias("geometry"))
    ts = F.try_to_timestamp(F.regexp_extract("stem", r"_([0-9]{8}T[0-9]{4})", 1), F.lit("yyyyMMdd'T'HHmm"))
    return images.join(geometry, "stem").withColumn("ts", ts)


def flatten_pixels(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``category, key, value`` of ``{category: {key: value}}`` texts."""
    outer = df.select(*keys, F.explode(F.from_json(text, "map<string, map<string, double>>")).alias("category", "_m"))
    return outer.select(*keys, "category", F.explode("_m").alias("key", "value"))


def albers(lat: Column, lon: Column, low: float, high: float, origin_lat: float, origin_lon: float, radius: float = 6_378_137.0) -> tuple[Column, Column]:
    """Equal-area conic coordinates on a sphere; the standard parallels lie a
    sixth of the range inside its ends."""
    p1, p2 = math.radians(low + (high - low) / 6), math.radians(high - (high - low) / 6)
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    rho = lambda s: F.sqrt(c - 2 * n * s) / n
    theta = n * F.radians(lon - origin_lon)
    rho0 = math.sqrt(c - 2 * n * math.sin(math.radians(origin_lat))) / n
    here = rho(F.sin(F.radians(lat)))
    return radius * here * F.sin(theta), radius * (rho0 - here * F.cos(theta))
