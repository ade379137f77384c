"""Writing results: partitioned tables, parameters, JSON merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cube(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """Parquet partitioned by grid, rows of a file in frame and pixel order, so
    that row-group statistics prune spatial filters."""
    order = [c for c in ("frame_idx", "y", "x") if c in df.columns]
    df.repartition(*by).sortWithinPartitions(*by, *order).write.mode(mode).partitionBy(*by).option("compression", "zstd").parquet(path)


def write_results(df: DataFrame, path: str, params: dict[str, str]) -> None:
    """A result relation and, beside it, the parameters of its run."""
    spark: SparkSession = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(params.items())], "name string, value string").write.mode("overwrite").parquet(f"{path}/run_params")


def write_raster(df: DataFrame, path: str, value: str) -> None:
    """``y, x`` and a value as lines of comma-separated numbers without a
    header, in files whose names follow the rows. Null is an empty field."""
    cell = F.struct("x", F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))
    lines = df.groupBy("y").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    lines = lines.select("y", F.concat_ws(",", F.transform("cells", lambda c: c["v"])).alias("value"))
    lines.repartitionByRange("y").sortWithinPartitions("y").select("value").write.text(path)


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One column recomputed, all others as they are."""
    return df.select(*[value.alias(c) if c == name else F.col(c) for c in df.columns])


def merge_pixels(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keyed upsert: new values win; NaN and infinities become null."""
    clean = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    a = old.select(*keys, F.col(value).alias("_old"))
    b = new.select(*keys, clean.alias("_new"), F.lit(True).alias("_hit"))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("_old")).alias(value))


def pixels_as_json(df: DataFrame, keys: list[str], category: str, key: str, value: str) -> DataFrame:
    """``{category: {key: value}}`` texts, one for each of ``keys``."""
    inner = df.groupBy(*keys, category).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))).alias("_m"))
    return inner.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(category).alias("c"), F.col("_m")), ), lambda a, b: F.when(a["c"] < b["c"], -1).otherwise(1)))).alias("json"))


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
