"""Queries that chain several operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time
from ..operators import complexity, components, detect, frequency, raster, series, stats, zscore
from ..sources import metadata, sinks
from .registry import query, table
from .spectra import _grid


@query("""WITH e AS (SELECT user_id, value, pi() * (2 * ((epoch_us(ts) - min(epoch_us(ts)) OVER w) / CAST(max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w AS DOUBLE)) - 1) AS p FROM events WINDOW w AS (PARTITION BY user_id)), k AS (SELECT unnest(range(0, 16)) AS k)
 SELECT user_id, CAST(k AS INTEGER) AS k, round(sqrt(pow(sum(value * cos(k * p)), 2) + pow(sum(value * sin(k * p)), 2)), 3) AS amp FROM e, k GROUP BY 1, 2""")
def frq09_integer_spectrum(spark, sf_dir):
    """Type-1 transform of unevenly sampled values at whole frequencies."""
    w = Window.partitionBy("user_id")
    t = time.micros(F.col("ts"))
    phase = math.pi * (2 * ((t - F.min(t).over(w)) / (F.max(t).over(w) - F.min(t).over(w)).cast("double")) - 1)
    rows = table(spark, sf_dir, "events").select("user_id", "value", phase.alias("p"))
    return frequency.integer_spectrum(rows, ["user_id"], "p", "value", 16).select("user_id", "k", F.round("amp", 3).alias("amp"))


@query("""WITH g AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS y, CAST(p_partkey % 50 AS INTEGER) AS x, p_retailprice AS v FROM part), t AS (SELECT unnest(range(0, 22)) AS tx), u AS (SELECT tx, unnest(range(0, 1 + CAST(floor((SELECT max(y) + 1e-1 FROM g) / 23e-1) AS BIGINT))) AS ty FROM t)
 SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, v FROM u JOIN g ON g.x = CAST(round_even(tx * 23e-1 + 4e-1, 0) AS INTEGER) AND g.y = CAST(round_even(ty * 23e-1 + 4e-1, 0) AS INTEGER)""")
def mos03_nearest_reprojection(spark, sf_dir):
    """A raster onto a coarser grid that covers it, nearest pixel."""
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select(F.floor(k / 50).cast("int").alias("y"), (k % 50).cast("int").alias("x"), F.col("p_retailprice").alias("v"))
    rows = g.agg(F.floor((F.max("y") + 0.1) / 2.3).cast("int").alias("last")).select(F.explode(F.sequence(F.lit(0), "last")).alias("ty"))
    cells = rows.repartition("ty").select("ty", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("tx"))
    at = cells.select("ty", "tx", raster.to_pixel(F.col("tx") * 2.3 + 0.4, 0.0, 1.0).alias("x"), raster.to_pixel(F.col("ty") * 2.3 + 0.4, 0.0, 1.0).alias("y"))
    return at.join(g, ["y", "x"]).select("ty", "tx", "v")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(CAST(ts AS DATE)) FROM events) AS TIMESTAMP), CAST((SELECT max(CAST(ts AS DATE)) FROM events) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day),
 j AS (SELECT s.day, (SELECT max(d.day) FROM d WHERE d.day <= s.day) AS a, (SELECT min(d.day) FROM d WHERE d.day >= s.day) AS b FROM s)
 SELECT CAST(j.day AS VARCHAR) AS day, round(CASE WHEN a IS NULL THEN y.v WHEN b IS NULL OR a = b THEN x.v ELSE x.v + (y.v - x.v) * (j.day - a) / (b - a) END, 6) AS v FROM j LEFT JOIN d x ON x.day = a LEFT JOIN d y ON y.day = b""")
def fn18_daily_gap_fill(spark, sf_dir):
    """Daily means on a whole calendar: gaps filled linearly, ends held."""
    ev = table(spark, sf_dir, "events")
    daily = ev.where("event_type = 'click'").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    spine = ev.agg(F.sequence(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).alias("d")).select(F.explode("d").alias("day"))
    rows = spine.join(daily, "day", "left").withColumn("n", F.unix_date("day"))
    w = Window.orderBy("n")  # one row a day
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct("n", "v"))
    rows = rows.withColumn("a", F.last(known, ignorenulls=True).over(before)).withColumn("b", F.first(known, ignorenulls=True).over(after))
    lerp = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("n") - F.col("a.n")) / F.nullif(F.col("b.n") - F.col("a.n"), F.lit(0))
    return rows.select(F.col("day").cast("string").alias("day"), F.round(F.coalesce(lerp, F.col("a.v"), F.col("b.v")), 6).alias("v"))


@query()
def win03_cube_complexity_zscores(spark, sf_dir):
    """Complexity of a cube, two frames for each raster of vectors, and its three
    z-scores."""
    from ..model import Cube

    rows = _grid(spark, sf_dir, 20, 25).select((2 * F.col("frame")).cast("int").alias("first"), "y", "x", F.col("s").alias("spectrum"), F.lit(False).alias("invalid"))
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")).withColumn("spectrum", F.transform("spectrum", lambda v, i: v * (1 + F.col("turn") * 0.1 * i)))
    rows = rows.withColumn("frame_idx", F.col("first") + F.col("turn")).drop("first", "turn")
    frames = rows.select("frame_idx").distinct().select("frame_idx", F.lit("a").alias("spacecraft"), F.col("frame_idx").alias("ts"))
    return Cube(rows, frames, 25, 20).standardised(band_rows=8).drop("ts")


@query()
def win07_legacy_reductions(spark, sf_dir):
    """Tiles by the sum of their volumes from the fourth on."""
    v = complexity.volume_curves(_grid(spark, sf_dir, 20).withColumn("id", F.col("y") * 20 + F.col("x")).withColumn("tile", F.floor(F.col("y") / 5)), ["tile"], "id", "s", 7, "endmemberMean")
    return v.where("m > 3").groupBy("tile").agg(F.max("volume").alias("peak"), F.sum("volume").alias("total"), F.max(F.when(F.col("m") == 4, F.col("volume"))).alias("third"))


@query()
def det07_retrospective_scoring(spark, sf_dir):
    """Sequences to scores to drift statuses, then the first drift of a key."""
    rows = series.last_sequence(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 6)
    mean = F.aggregate("sequence", F.lit(0.0), lambda s, x: s + x) / 6
    rows = rows.select("user_id", "ts", "event_id", (F.abs(F.col("value") - mean) / 100).alias("score"), F.lit(True).alias("ok"))
    out = detect.drift_statuses(rows, ["user_id"], ["ts", "event_id"], "score", "ok", detect.Drift(drift=2.0, run=2))
    return out.groupBy("user_id").agg(F.min(F.when(F.col("status") == 2, F.col("ts"))).alias("first_drift"), F.count_if(F.col("status") == 2).alias("drift_count"))


@query("""WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS us, value, avg(ln(value)) OVER p AS m, stddev_samp(ln(value)) OVER p AS s, row_number() OVER o AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER o AS dt, dayofyear(ts) AS doy FROM events WHERE value > 0 WINDOW p AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event_id, round(greatest(-5e0, least(5e0, (ln(value) - m) / nullif(s, 0))), 6) AS z, round(sin(2 * pi() * doy / 365.25e0), 7) AS doy_sin, round(1 - exp(-1e-1 * dt / 8.64e10), 7) AS weight, CAST(n AS BIGINT) AS pos FROM w""")
def ml01_sample_features(spark, sf_dir):
    """The feature rows that the series models are given."""
    from ..functions._clip import clip

    rows = zscore.log_zscore(table(spark, sf_dir, "events").where("value > 0").withColumn("us", time.micros(F.col("ts"))), "value", ["user_id"])
    rows = series.intervals(series.chronological(rows, ["user_id"], ["ts", "event_id"], "pos"), ["user_id"], ["ts", "event_id"], F.col("us"), "dt")
    sine, _ = time.cyclic(time.day_of_year_phase(F.col("ts")))
    return rows.select("event_id", F.round(clip(F.col("z"), -5.0, 5.0), 6).alias("z"), F.round(sine, 7).alias("doy_sin"), F.round(time.decay_weight(F.col("dt") / 8.64e10, 0.1), 7).alias("weight"), F.col("pos").cast("long").alias("pos"))


@query()
def ml04_default_scorer(spark, sf_dir):
    """Distances of each key's vectors flagged at a contamination of a fifth."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("half"), "embedding")
    return stats.contamination(components.mahalanobis(rows, ["half"], "vec_id", "embedding"), "distance", 0.2)


@query()
def src24_patch_sample(spark, sf_dir):
    """Crops of 8 x 8 pixels at places drawn by a seeded hash."""
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select(F.floor(k / 50).cast("int").alias("y"), (k % 50).cast("int").alias("x"), F.col("p_retailprice").alias("v"))
    patch = spark.range(6).select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)).cast("int").alias("y0"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(42)).cast("int").alias("x0"))
    cells = patch.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("c"))
    at = cells.select("id", (F.col("y0") + F.floor(F.col("c") / 8)).cast("int").alias("y"), (F.col("x0") + F.col("c") % 8).cast("int").alias("x"))
    return at.join(g, ["y", "x"])


@query("""SELECT user_id, event_type, value FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.v, a.v) AS value FROM (SELECT user_id, event_type, min(value) AS v FROM events WHERE value < 100 GROUP BY 1, 2) a FULL JOIN (SELECT user_id, event_type, max(value) AS v FROM events WHERE value > 200 GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type = b.event_type)""")
def snk10_json_upsert(spark, sf_dir):
    """Pixel values merged by key, written as JSON and read back."""
    ev = table(spark, sf_dir, "events")
    old = ev.where("value < 100").groupBy("user_id", "event_type").agg(F.min("value").alias("value"))
    new = ev.where("value > 200").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    merged = sinks.merge_pixels(old, new, ["user_id", "event_type"], "value").withColumn("k", F.lit("v"))
    text = sinks.pixels_as_json(merged, ["user_id"], "event_type", "k", "value")
    return metadata.flatten_pixels(text, "json", ["user_id"]).select("user_id", F.col("category").alias("event_type"), "value")


@query("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size * 2 AS INTEGER) AS p_size FROM part")
def snk14_snk15_replace_and_drop(spark, sf_dir):
    """One column recomputed, another left out."""
    return sinks.replace_column(table(spark, sf_dir, "part").drop("p_retailprice"), "p_size", (F.col("p_size") * 2).cast("int"))
