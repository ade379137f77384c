"""Scene catalogues: boxes, overlaps, grids, metadata texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..operators._tables import scratch
from ..sources import cube, metadata, readers, sinks
from .registry import query, table

_S = "WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_custkey * 37 % 1000 AS DOUBLE) END AS x0, CAST(c_custkey * 91 % 700 AS DOUBLE) AS y0, CAST(c_custkey * 37 % 1000 + 8 + c_custkey % 9 AS DOUBLE) AS x1, CAST(c_custkey * 91 % 700 + 8 + c_custkey % 7 AS DOUBLE) AS y1 FROM customer)"


def _scenes(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k * 37 % 1000), (k * 91 % 700)
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 50 != 0, x.cast("double")).alias("x0"), y.cast("double").alias("y0"), (x + 8 + k % 9).cast("double").alias("x1"), (y + 8 + k % 7).cast("double").alias("y1")
    )


def _areas(spark, rows):
    return spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")


@query(_S + " SELECT id FROM s WHERE x0 <= 300 AND 100 <= x1 AND y0 <= 250 AND 50 <= y1")
def pred04_bbox(spark, sf_dir):
    box = tuple(map(F.lit, (100.0, 50.0, 300.0, 250.0)))
    return _scenes(spark, sf_dir).where(joins.bbox_intersects(tuple(map(F.col, ("x0", "y0", "x1", "y1"))), box)).select("id")


@query(_S + " SELECT id FROM s WHERE x0 IS NOT NULL AND NOT (x0 <= 200 AND 150 <= x1 AND y0 <= 200 AND 100 <= y1) AND ((x0 <= 400 AND 0 <= x1 AND y0 <= 300 AND 0 <= y1) OR (x0 <= 900 AND 800 <= x1 AND y0 <= 700 AND 500 <= y1))")
def pred05_include_exclude(spark, sf_dir):
    include = _areas(spark, [(0.0, 0.0, 400.0, 300.0), (800.0, 500.0, 900.0, 700.0)])
    return joins.spatial_filter(_scenes(spark, sf_dir), include, _areas(spark, [(150.0, 100.0, 200.0, 200.0)])).select("id")


_PAIRS = _S + """, p AS (SELECT a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS cover
 FROM s a JOIN s b ON a.id > b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"""


@query(_PAIRS + " SELECT a, b, round(cover, 7) AS cover FROM p WHERE cover >= 5e-1")
def jn07_scene_overlap(spark, sf_dir):
    pairs = joins.overlapping_boxes(_scenes(spark, sf_dir), "id", 20.0, 0.5)
    return pairs.select("a", "b", F.round("cover", 7).alias("cover"))


@query(_PAIRS.replace("WITH s AS", "WITH RECURSIVE s AS") + """, e AS (SELECT a, b FROM p WHERE cover >= 5e-1 UNION SELECT b, a FROM p WHERE cover >= 5e-1), r AS (SELECT DISTINCT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a) SELECT id, min(seen) AS component FROM r GROUP BY 1""")
def jn08_components(spark, sf_dir):
    return joins.overlap_components(_scenes(spark, sf_dir), "id", 20.0, 0.5)


@query(_S + " SELECT CAST(floor((x0 / 3 + 180) / 6) AS INTEGER) + 1 AS zone, min(least(x0, x1)) AS lo, max(greatest(x0, x1)) AS hi, CAST(ceil((max(x1) - min(x0)) / 30e0) AS INTEGER) AS cols FROM s WHERE x0 IS NOT NULL GROUP BY 1")
def mos05_mos06_zone_grid(spark, sf_dir):
    """Zone of each scene, the union of its boxes and the grid they need."""
    zone = F.floor((F.col("x0") / 3 + 180) / 6).cast("int") + 1
    return _scenes(spark, sf_dir).where("x0 is not null").groupBy(zone.alias("zone")).agg(
        F.min(F.least("x0", "x1")).alias("lo"), F.max(F.greatest("x0", "x1")).alias("hi"), F.ceil((F.max("x1") - F.min("x0")) / 30.0).cast("int").alias("cols")
    )


@query("""WITH b AS (SELECT min(n_nationkey) * 2e0 + 10 AS lat0, max(n_nationkey) * 2e0 + 10 AS lat1 FROM nation), p AS (SELECT radians(lat0 + (lat1 - lat0) / 6) AS p1, radians(lat1 - (lat1 - lat0) / 6) AS p2, radians((lat0 + lat1) / 2) AS p0 FROM b),
 c AS (SELECT *, (sin(p1) + sin(p2)) / 2 AS n, pow(cos(p1), 2) + (sin(p1) + sin(p2)) * sin(p1) AS c FROM p)
 SELECT n_nationkey, round(6378137e0 * sqrt(c - 2 * n * sin(radians(n_nationkey * 2e0 + 10))) / n * sin(n * radians(n_nationkey * 3e0 - 36)), 3) AS x,
 round(6378137e0 * (sqrt(c - 2 * n * sin(p0)) / n - sqrt(c - 2 * n * sin(radians(n_nationkey * 2e0 + 10))) / n * cos(n * radians(n_nationkey * 3e0 - 36))), 3) AS y FROM nation, c""")
def mos04_albers_grid(spark, sf_dir):
    """Equal-area coordinates with standard parallels by the one-sixth rule."""
    lat, lon = F.col("n_nationkey") * 2.0 + 10, F.col("n_nationkey") * 3.0
    nation = table(spark, sf_dir, "nation")
    lo, hi = nation.agg(F.min(lat), F.max(lat)).first()
    x, y = metadata.albers(lat, lon, lo, hi, (lo + hi) / 2, 36.0)
    return nation.select("n_nationkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""SELECT s_suppkey, CAST(regexp_extract(t, 'UpperLeftPointMtrs=\\(([-0-9.]+),', 1) AS DOUBLE) AS ulx, CAST(regexp_extract(t, 'ZoneCode=(-?[0-9]+)', 1) AS INTEGER) AS zone,
 CASE WHEN CAST(regexp_extract(t, 'ZoneCode=(-?[0-9]+)', 1) AS INTEGER) < 0 THEN 32700 ELSE 32600 END + abs(CAST(regexp_extract(t, 'ZoneCode=(-?[0-9]+)', 1) AS INTEGER)) AS epsg
 FROM (SELECT s_suppkey, 'GROUP=GridStructure XDim=10 UpperLeftPointMtrs=(' || printf('%.1f', s_suppkey * 30e0) || ',5.0) ZoneCode=' || CAST(s_suppkey % 60 - 30 AS VARCHAR) || ' END' AS t FROM supplier)""")
def src23_grid_text(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("GROUP=GridStructure XDim=10 UpperLeftPointMtrs=("), F.format_string("%.1f", k * 30.0), F.lit(",5.0) ZoneCode="), (k % 60 - 30).cast("string"), F.lit(" END"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", metadata.grid_parameters(text).alias("g"))
    return rows.select("s_suppkey", F.col("g.ul_x").alias("ulx"), "g.zone", "g.epsg")


@query("""SELECT s_suppkey, s_nationkey AS scene, CAST(s_acctbal AS DOUBLE) AS cloud FROM supplier""")
def src07_scene_xml(spark, sf_dir):
    """Records out of XML texts."""
    xml = F.format_string("<S><ID>%d</ID><CLOUD>%s</CLOUD></S>", F.col("s_nationkey"), F.col("s_acctbal").cast("string"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.from_xml(xml, "ID int, CLOUD double").alias("r"))
    return rows.select("s_suppkey", F.col("r.ID").alias("scene"), F.col("r.CLOUD").alias("cloud"))


@query("""SELECT s_suppkey, 'L1B' AS level, 32600 + s_nationkey AS epsg, CAST(i AS INTEGER) AS band, 400e0 + 10 * i AS nm FROM (SELECT s_suppkey, s_nationkey, unnest(range(0, 3)) AS i FROM supplier)""")
def src11_scene_json(spark, sf_dir):
    k = F.col("s_suppkey")
    js = F.format_string('{"properties":{"level":"L1B","epsg":%d},"bands":[{"nm":400.0},{"nm":410.0},{"nm":420.0}]}', F.lit(32600) + F.col("s_nationkey"))
    rows = table(spark, sf_dir, "supplier").select(k, metadata.scene_record(js).alias("r"))
    return rows.select("s_suppkey", "r.level", "r.epsg", F.posexplode("r.bands").alias("band", "b")).select("s_suppkey", "level", "epsg", "band", F.col("b.nm").alias("nm"))


@query("""WITH f AS (SELECT 'scene' || s_suppkey || '_20240102T0304.hsi' AS p, s_suppkey FROM supplier UNION ALL SELECT 'scene' || s_suppkey || '_20240102T0304_igm.dat', s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) SELECT 'scene' || s_suppkey || '_20240102T0304' AS stem, TIMESTAMP '2024-01-02 03:04:00' AS ts FROM supplier WHERE s_suppkey % 3 = 0""")
def src13_paired_files(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    stem = F.concat(F.lit("scene"), F.col("s_suppkey").cast("string"), F.lit("_20240102T0304"))
    files = s.select(F.concat(stem, F.lit(".hsi")).alias("path")).unionByName(s.where("s_suppkey % 3 = 0").select(F.concat(stem, F.lit("_igm.dat")).alias("path")))
    return metadata.paired_files(files, "path").select("stem", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""SELECT user_id, event_type AS category, event_id, value FROM events""")
def src19_pixel_json(spark, sf_dir):
    """Nested ``{category: {key: value}}`` texts flattened to rows."""
    ev = table(spark, sf_dir, "events")
    inner = ev.groupBy("user_id", "event_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), "value"))).alias("m"))
    text = inner.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "m")))).alias("js"))
    return metadata.flatten_pixels(text, "js", ["user_id"]).select("user_id", "category", F.col("key").cast("long").alias("event_id"), "value")


@query("""SELECT CAST(vec_id // 400 AS INTEGER) AS frame, CAST(vec_id % 400 // 20 AS INTEGER) AS y, CAST(vec_id % 20 AS INTEGER) AS x, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS peak
 FROM embeddings WHERE vec_id % 400 // 20 BETWEEN 5 AND 12 AND vec_id % 20 >= 14""")
def src01_cube_hyperslab(spark, sf_dir):
    """All vectors written as a cube of 20 x 20 pixels a frame; then a window of
    every frame, for which only the tiles that it meets are opened."""
    v = F.col("vec_id")
    pixels = table(spark, sf_dir, "embeddings").select(F.floor(v / 400).alias("frame"), F.floor(v % 400 / 20).alias("y"), (v % 20).alias("x"), F.col("embedding").alias("spectrum"))
    path = scratch(pixels, "cube")
    cube.write_tiles(pixels, path, tile=8)
    window = cube.read_tiles(spark, path).where("y between 5 and 12 and x >= 14")
    return window.select("frame", "y", "x", F.get("spectrum", F.lit(0)).alias("first"), F.array_max("spectrum").alias("peak"))


@query("""SELECT p_partkey // 50 AS y, p_partkey % 50 AS x, CAST(p_size AS DOUBLE) AS a, CAST(p_retailprice AS DOUBLE) AS b, round(p_retailprice - p_size, 6) AS apart FROM part""")
def src18_raster_pair(spark, sf_dir):
    """Two headerless rasters written from the parts, read in splits and joined
    by place."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("y"), (k % 50).alias("x"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"))
    paths = [scratch(rows, f"raster-{c}") for c in "ab"]
    for c, path in zip("ab", paths, strict=True):
        sinks.write_raster(rows, path, c)
    return readers.raster_pair(spark, *paths).select("y", "x", "a", "b", F.round(F.col("b") - F.col("a"), 6).alias("apart"))
