"""Text formats read as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._tables import written


def delimited_after_header(spark: SparkSession, path: str, skip: int, names: list[str], fill: float | None = None, delimiter: str = ",") -> DataFrame:
    """A CSV whose table starts after ``skip`` lines and a header line. Lines
    are told from the preamble by their number of fields, so files stay
    splittable: only rows with as many fields as ``names`` are numbers."""
    fields = F.split("value", delimiter)
    rows = spark.read.text(path).where(F.size(fields) == len(names)).select(fields.alias("f"))
    out = rows.select(*[F.expr(f"try_cast(trim(f[{i}]) as double)").alias(n) for i, n in enumerate(names)]).where(F.col(names[-1]).isNotNull())
    if fill is not None:
        for n in names:
            out = out.where(F.col(n) != fill)
    return out


def irradiance_table(spark: SparkSession, path: str, factor: float = 10.0) -> DataFrame:
    """White-space columns ``nm, irradiance``; lines that start with ``#`` or
    hold no numbers are skipped, the irradiance is scaled."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 2)
    out = rows.select(F.expr("try_cast(f[0] as double)").alias("nm"), (F.expr("try_cast(f[1] as double)") * factor).alias("irradiance"))
    return out.where(F.col("nm").isNotNull() & F.col("irradiance").isNotNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (from 0) and ``value`` of text files, which are split like any
    other: lines of each split are counted, and the counts of the splits before
    it are added. Several files count on in order of their paths."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = written(lines)  # once, so the places of the lines stay as they are
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    total, before = 0, []
    for r in splits.orderBy("file", "block").collect():  # a row for each split
        before.append((r["file"], r["block"], r["first"], total))
        total += r["n"]
    starts = spark.createDataFrame(before, "file string, block long, first long, before long")
    return lines.join(F.broadcast(starts), ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def raster_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raster without a header: ``y, x, value``. The row is the line's number;
    fields that are no numbers are null."""
    fields = numbered_lines(spark, path).select(F.col("line").alias("y"), F.posexplode(F.split("value", ",")).alias("x", "v"))
    return fields.select("y", F.col("x").cast("long").alias("x"), F.expr("try_cast(trim(v) as double)").alias("value"))


def raster_pair(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Two rasters of one shape side by side: ``y, x, a, b``; places that only
    one of them has are null in the other."""
    a, b = raster_csv(spark, first).withColumnRenamed("value", "a"), raster_csv(spark, second).withColumnRenamed("value", "b")
    return a.join(b, ["y", "x"], "full")


def pixel_samples(spark: SparkSession, path: str) -> DataFrame:
    """Pixel samples as JSON of either shape: an object by category and pixel
    key, or one by pixel key alone (category null)."""
    text = spark.read.text(path, wholetext=True)
    two = F.from_json("value", "map<string, map<string, array<double>>>", {"mode": "PERMISSIVE"})
    one = F.from_json("value", "map<string, array<double>>", {"mode": "PERMISSIVE"})
    a = text.select(F.explode(two).alias("category", "m")).select("category", F.explode("m").alias("pixel", "series"))
    b = text.select(F.lit(None).cast("string").alias("category"), F.explode(one).alias("pixel", "series"))
    return a.unionByName(b).where(F.col("series").isNotNull())


def scene_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a folder (``path``, ``length``, ``modificationTime``); of
    scenes with one product id (text before the first ``_``) the newest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("product", F.split(name, "_")[0])
    best = files.groupBy("product").agg(F.max(F.struct("modificationTime", "path", "length")).alias("m"))
    return best.select("product", "m.path", "m.length", "m.modificationTime")
