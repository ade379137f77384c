"""Stacks of scenes, resampled grids, colour images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time
from ..operators import extremes, stacks
from ..operators._tables import scratch, written
from ..sources import archives
from .registry import query, table
from .spatial import _G, _grid, _height

_GAP = 30 * 86_400_000_000


@query(f"""WITH g AS (SELECT o_orderkey, o_custkey, o_orderstatus, us, CASE WHEN us - lag(us) OVER w > {_GAP} THEN 1 ELSE 0 END AS split FROM (SELECT *, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY us, o_orderkey)),
 p AS (SELECT *, sum(split) OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey) AS session FROM g),
 l AS (SELECT l_orderkey, CAST(l_suppkey % 4 AS INTEGER) AS y, CAST(l_partkey % 2 AS INTEGER) AS x, CASE WHEN l_quantity > 5 THEN [CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE), CAST(l_tax AS DOUBLE)] END AS s, CASE l_returnflag WHEN 'A' THEN 255 WHEN 'R' THEN 1 ELSE 0 END AS mask FROM lineitem),
 c AS (SELECT o_custkey, session, y, x, max({{'us': us, 'k': o_orderkey, 's': s}}) FILTER (WHERE s IS NOT NULL) AS m, coalesce(min(mask) FILTER (WHERE mask <> 255), 255) AS mask FROM p JOIN l ON l_orderkey = o_orderkey GROUP BY ALL),
 f AS (SELECT o_custkey, session, count(*) FILTER (WHERE mask = 0 AND m IS NOT NULL) * 100e0 / 8 AS coverage FROM c GROUP BY ALL HAVING coverage >= 20),
 t AS (SELECT o_custkey, session, min(us) AS frame_us FROM p GROUP BY ALL), b AS (SELECT bool_and(o_orderstatus <> 'P') AS third FROM orders)
 SELECT o_custkey, CAST(session AS BIGINT) AS session, frame_us, coverage, y, x, m.s[1] AS b0, m.s[2] AS b1, CASE WHEN third THEN m.s[3] END AS b2, CAST(mask AS INTEGER) AS mask FROM c JOIN f USING (o_custkey, session) JOIN t USING (o_custkey, session), b""")
def src09_src10_src12_sensor_stack(spark, sf_dir):
    """Scan, passes, mosaic, coverage and common good bands as one plan: an
    order is a scene of its customer's sensor, a line one of its pixels."""
    o, q = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    scenes = o.select("o_custkey", F.col("o_orderkey").alias("scene"), time.micros(F.col("o_orderdate").cast("timestamp_ntz")).alias("us"), F.lit(32610).alias("epsg"), F.array(F.lit(True), F.lit(True), F.col("o_orderstatus") != "P").alias("good"))
    spectrum = F.when(F.col("l_quantity") > 5, F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_tax")]))
    mask = F.when(F.col("l_returnflag") == "A", 255).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    pixels = q.select(F.col("l_orderkey").alias("scene"), (F.col("l_suppkey") % 4).cast("int").alias("y"), (F.col("l_partkey") % 2).cast("int").alias("x"), spectrum.alias("spectrum"), mask.alias("mask"))
    out = stacks.sensor_stack(scenes, pixels, ["o_custkey"], _GAP, 8)
    return out.select("o_custkey", "session", "frame_us", "coverage", "y", "x", *[F.get("spectrum", F.lit(i)).alias(f"b{i}") for i in range(3)], "mask")


_TARGETS = "t AS (SELECT s_suppkey AS t_id, (s_suppkey % 10) * 5 + 37e-2 AS tx, (s_suppkey // 10) * 4 + 61e-2 AS ty FROM supplier)"


@query(_G + f""", {_TARGETS}, p AS (SELECT split_part(p_brand, '#', 1) AS pass, p_brand AS chunk, p_partkey AS p_id, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_partkey // 50 AS DOUBLE) AS y, p_retailprice AS value FROM part),
 d AS (SELECT pass, chunk, t_id, p_id, value, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS d FROM t JOIN p ON x BETWEEN tx - 2 AND tx + 2 AND y BETWEEN ty - 2 AND ty + 2), n AS (SELECT *, row_number() OVER (PARTITION BY pass, chunk, t_id ORDER BY d, p_id) AS r FROM d WHERE d <= 1.8e0)
 SELECT pass, t_id, max_by(value, chunk) AS value FROM n WHERE r = 1 GROUP BY 1, 2""")
def src14_swath_stack(spark, sf_dir):
    """Swath chunks, grouped by the prefix of their names, on a grid."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "part").select(F.split("p_brand", "#")[0].alias("pass"), F.col("p_brand").alias("chunk"), k.alias("p_id"), (k % 50).cast("double").alias("x"), F.floor(k / 50).cast("double").alias("y"), F.col("p_retailprice").alias("value"))
    targets = table(spark, sf_dir, "supplier").select(s.alias("t_id"), ((s % 10) * 5 + 0.37).alias("x"), (F.floor(s / 10) * 4 + 0.61).alias("y"))
    return stacks.swath_stack(points, targets, ["pass"], 1.8)


def _targets(spark, rows):
    """A grid of every 2.3 pixels over the whole raster."""
    tall = int((_height(rows) - 1) / 2.3) + 1
    cells = spark.range(tall * 21).select(F.floor(F.col("id") / 21).cast("int").alias("ty"), (F.col("id") % 21).cast("int").alias("tx"))
    return cells.select("ty", "tx", (F.col("ty") * 2.3).alias("y"), (F.col("tx") * 2.3).alias("x"))


_AT = _G + """, e AS (SELECT CAST(floor(max(y) / 23e-1) AS INTEGER) + 1 AS tall FROM g), a AS (SELECT unnest(range(0, tall)) AS ty FROM e), t AS (SELECT ty, unnest(range(0, 21)) AS tx FROM a), w AS (SELECT ty, tx, ty * 23e-1 AS ry, tx * 23e-1 AS rx FROM t),
 n AS (SELECT w.*, CAST(floor(ry) AS INTEGER) + i.i AS y, CAST(floor(rx) AS INTEGER) + j.j AS x FROM w, (SELECT unnest(range({lo}, {hi})) AS i) i, (SELECT unnest(range({lo}, {hi})) AS j) j)"""


@query(_AT.format(lo=0, hi=2) + """, k AS (SELECT ty, tx, v, greatest(0, 1 - abs(y - ry)) * greatest(0, 1 - abs(x - rx)) AS w FROM n JOIN g USING (y, x))
 SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, round(sum(w * v) / sum(w), 6) AS v FROM k GROUP BY 1, 2 HAVING sum(w) > 1e-9""")
def mos03_bilinear(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return stacks.resample(g, "v", _targets(spark, g)).withColumn("v", F.round("v", 6))


def _cubic_sql(d):
    return f"CASE WHEN abs({d}) <= 1 THEN (15e-1 * abs({d}) - 25e-1) * abs({d}) * abs({d}) + 1 WHEN abs({d}) < 2 THEN ((-5e-1 * abs({d}) + 25e-1) * abs({d}) - 4) * abs({d}) + 2 ELSE 0 END"


@query(_AT.format(lo=-1, hi=3) + f""", k AS (SELECT ty, tx, v, ({_cubic_sql('(y - ry)')}) * ({_cubic_sql('(x - rx)')}) AS w FROM n JOIN g USING (y, x))
 SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, round(sum(w * v) / sum(w), 6) AS v FROM k GROUP BY 1, 2 HAVING abs(sum(w)) > 1e-9""")
def mos03_cubic(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return stacks.resample(g, "v", _targets(spark, g), "cubic").withColumn("v", F.round("v", 6))


@query(_G + " SELECT CAST(floor((y + 5e-1) / 23e-1) AS INTEGER) AS ty, CAST(floor((x + 5e-1) / 23e-1) AS INTEGER) AS tx, round(avg(v), 6) AS v FROM g GROUP BY 1, 2")
def mos03_average(spark, sf_dir):
    return stacks.average(_grid(spark, sf_dir), "v", 2.3).withColumn("v", F.round("v", 6))


@query("""WITH p AS (SELECT event_type, quantile_cont(value, 2e-2) AS l0, quantile_cont(value, 98e-2) AS h0, quantile_cont(user_id, 2e-2) AS l1, quantile_cont(user_id, 98e-2) AS h1, quantile_cont(event_id, 2e-2) AS l2, quantile_cont(event_id, 98e-2) AS h2 FROM events GROUP BY 1)
 SELECT event_id, round(greatest(0, least(1, (value - l0) / nullif(h0 - l0, 0))), 7) AS red, round(greatest(0, least(1, (user_id - l1) / nullif(h1 - l1, 0))), 7) AS green, round(greatest(0, least(1, (event_id - l2) / nullif(h2 - l2, 0))), 7) AS blue FROM events JOIN p USING (event_type)""")
def fn25_colour_image(spark, sf_dir):
    rows = stacks.colour_image(table(spark, sf_dir, "events").where("event_type is not null"), ["event_type"], ("value", "user_id", "event_id"))
    return rows.select("event_id", *[F.round(c, 7).alias(c) for c in ("red", "green", "blue")])


@query()
def spx07_projected_volumes(spark, sf_dir):
    return extremes.projected_volumes(table(spark, sf_dir, "embeddings").where("label is not null"), ["label"], "vec_id", "embedding", 7)


_DAY = 86_400_000_000


@query(f"""WITH l AS (SELECT p_partkey // 400 AS r, CAST(p_partkey % 400 // 20 AS INTEGER) AS y, CAST(p_partkey % 20 AS INTEGER) AS x, CASE WHEN p_size > 3 THEN [CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE)] END AS s,
  CASE WHEN p_size % 7 = 0 THEN 255 WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS mask FROM part),
 ok AS (SELECT r FROM l GROUP BY r HAVING (400 - count(*) + count(*) FILTER (WHERE mask <> 0)) / 400e0 <= 5e-1),
 q AS (SELECT *, (r // 2 * 40 + r % 2) * {_DAY} AS us, CAST(r // 2 AS BIGINT) AS pass FROM l JOIN ok USING (r)),
 c AS (SELECT pass, y, x, max({{'us': us, 's': s}}) FILTER (WHERE s IS NOT NULL) AS m, coalesce(min(mask) FILTER (WHERE mask <> 255), 255) AS mask FROM q GROUP BY ALL),
 t AS (SELECT pass, min(us) AS frame_us FROM q GROUP BY 1)
 SELECT frame_us, y, x, m.s[1] AS b1, m.s[2] AS b2, CAST(mask AS INTEGER) AS mask FROM c JOIN t USING (pass)""")
def src06_src08_scene_files(spark, sf_dir):
    """Scenes of 400 parts written as folders and archives, every third as both;
    listed, made unique, judged by their quality rasters, read by strips and
    composed to frames."""
    k = F.col("p_partkey")
    r = F.floor(k / 400)
    mask = F.when(F.col("p_size") % 7 == 0, 255).when(F.col("p_size") % 5 == 0, 1).otherwise(0)
    spectrum = F.when(F.col("p_size") > 3, F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")))
    rows = table(spark, sf_dir, "part").select(r.alias("r"), F.floor(k % 400 / 20).alias("y"), (k % 20).alias("x"), spectrum.alias("spectrum"), mask.alias("mask"))
    forms = F.explode(F.when(F.col("r") % 3 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("r") % 2 == 0)))
    rows = rows.select(F.format_string("L%08d", "r").alias("scene"), ((F.floor(F.col("r") / 2) * 40 + F.col("r") % 2) * _DAY).alias("us"), F.lit(32610).alias("epsg"), forms.alias("packed"), "y", "x", "spectrum", "mask")
    root = scratch(rows, "scenes")
    archives.write_scenes(rows, root, 2, 20, 20)
    found = written(archives.members(spark, root))
    scenes = written(archives.clear_scenes(archives.catalogue(found), found, 20, lambda m: m != 0, 0.5))
    pixels = archives.scene_pixels(scenes, found, ["B1", "B2"], 20, strip=8)
    flags = scenes.withColumns({"sensor": F.lit("L"), "good": F.array(F.lit(True), F.lit(True))})
    # pixels that no scene has shown are not in the frame
    out = stacks.sensor_stack(flags, pixels, ["sensor"], 2 * _DAY, 400, least=0.0)
    return out.select("frame_us", "y", "x", F.get("spectrum", F.lit(0)).alias("b1"), F.get("spectrum", F.lit(1)).alias("b2"), "mask")
