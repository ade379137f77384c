"""Rasters: masks, neighbourhoods, windows. The raster is ``part`` laid out in
rows of 50 (``y = key div 50``, ``x = key mod 50``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, raster, zscore
from .registry import query, table

WIDTH = 50
_G = "WITH g AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS y, CAST(p_partkey % 50 AS INTEGER) AS x, p_retailprice AS v, p_size AS s FROM part)"


def _grid(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / WIDTH).cast("int").alias("y"), (k % WIDTH).cast("int").alias("x"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("s"))


def _height(rows):
    return (rows.agg(F.max("y")).first()[0] or 0) + 1


@query(_G + ", h AS (SELECT y, x FROM g WHERE s = 50) SELECT g.y, g.x, EXISTS (SELECT 1 FROM h WHERE abs(h.y - g.y) <= 2 AND abs(h.x - g.x) <= 2) AS dilated FROM g")
def msk05_dilation(spark, sf_dir):
    rows = _grid(spark, sf_dir).withColumn("flag", F.col("s") == 50)
    return raster.dilate(rows, [], "flag", 2).select("y", "x", "dilated")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE (k & 32) <> 0 AND k <> 99) AS n_flag, count(*) FILTER (WHERE k <> 99) AS n_seen FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1)
 SELECT user_id, n_flag, n_seen, n_seen > 0 AND n_flag >= 6e-1 * (SELECT max(n_flag) FROM c) AS persistent FROM c""")
def msk06_persistent_flag(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return raster.persistent(table(spark, sf_dir, "events"), ["user_id"], k.bitwiseAND(F.lit(32)) != 0, k != 99, 0.6)


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE value > 150) AS n FROM events GROUP BY 1), w AS (SELECT user_id FROM c WHERE n >= 5e-1 * (SELECT max(n) FROM c)) SELECT event_id, value > 300 OR user_id IN (SELECT user_id FROM w) AS invalid FROM events""")
def msk07_apply_persistent_mask(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    water = raster.persistent(ev, ["user_id"], F.col("value") > 150, F.lit(True), 0.5).select("user_id", "persistent")
    return ev.join(water, "user_id").select("event_id", ((F.col("value") > 300) | F.col("persistent")).alias("invalid"))


@query(_G + " SELECT CAST(y // 5 AS INTEGER) AS ty, CAST(x // 5 AS INTEGER) AS tx, count(*) AS n FROM g GROUP BY 1, 2 HAVING bool_and(s <> 50)")
def msk09_all_valid_tiles(spark, sf_dir):
    g = _grid(spark, sf_dir).groupBy(F.floor(F.col("y") / 5).cast("int").alias("ty"), F.floor(F.col("x") / 5).cast("int").alias("tx"))
    return g.agg(F.bool_and(F.col("s") != 50).alias("ok"), F.count("*").alias("n")).where("ok").drop("ok")


@query("""WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, round(a.v, 6) AS v1, round(b.v, 6) AS v2 FROM a JOIN b USING (user_id) WHERE a.v > 0 AND b.v > 0""")
def msk10_joint_mask(spark, sf_dir):
    side = lambda e, n: table(spark, sf_dir, "events").where(F.col("event_type") == e).groupBy("user_id").agg(F.avg("value").alias(n))
    both = side("click", "v1").join(side("view", "v2"), "user_id").where("v1 > 0 and v2 > 0")
    return both.select("user_id", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2"))


@query(_G + ", h AS (SELECT y, x FROM g WHERE s = 50) SELECT g.y, g.x FROM g WHERE s <> 50 AND NOT EXISTS (SELECT 1 FROM h WHERE (h.y - g.y) * (h.y - g.y) + (h.x - g.x) * (h.x - g.x) < 9)")
def msk11_distance_erosion(spark, sf_dir):
    rows = _grid(spark, sf_dir).withColumn("invalid", F.col("s") == 50)
    return raster.clear_of(rows, "invalid", 3.0).select("y", "x")


@query(_G + " SELECT y, x, (y - 10) * (y - 10) + (x - 10) * (x - 10) <= 36 OR (y - 20) * (y - 20) + (x - 30) * (x - 30) <= 36 AS inside FROM g")
def msk12_circular_points(spark, sf_dir):
    d2 = lambda a, b: (F.col("y") - a) * (F.col("y") - a) + (F.col("x") - b) * (F.col("x") - b)
    return _grid(spark, sf_dir).select("y", "x", ((d2(10, 10) <= 36) | (d2(20, 30) <= 36)).alias("inside"))


@query(_G + " SELECT a.y, a.x, count(*) AS n, round(avg(abs(a.v - b.v)), 6) AS gap FROM g a JOIN g b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2")
def jn10_neighbours(spark, sf_dir):
    n = joins.neighbours(_grid(spark, sf_dir), "v")
    return n.groupBy("y", "x").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("v") - F.col("other"))), 6).alias("gap"))


@query(_G + " SELECT y, x, v FROM g WHERE y BETWEEN 4 AND 6 AND x BETWEEN 9 AND 11")
def jn11_chip(spark, sf_dir):
    return _grid(spark, sf_dir).where(F.col("y").between(4, 6) & F.col("x").between(9, 11)).select("y", "x", "v")


@query(_G + " SELECT user_id, value FROM events WHERE user_id = 7")
def src02_pixel_series(spark, sf_dir):
    """One pixel over time: the filter reaches the Parquet scan."""
    return table(spark, sf_dir, "events").where("user_id = 7").select("user_id", "value")


_TARGETS = "t AS (SELECT s_suppkey AS t_id, (s_suppkey % 10) * 5 + 37e-2 AS tx, (s_suppkey // 10) * 4 + 61e-2 AS ty FROM supplier)"


@query(_G + f", {_TARGETS}, p AS (SELECT y * 50 + x AS p_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM g WHERE s > 40), d AS (SELECT t_id, p_id, sqrt(pow(x - tx, 2) + pow(y - ty, 2)) AS d FROM t, p), r AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY round(d, 9), p_id) AS n FROM d WHERE d <= 1.8e0) SELECT t_id, CAST(p_id AS BIGINT) AS p_id, round(d, 7) AS distance FROM r WHERE n = 1")
def jn09_nearest_in_radius(spark, sf_dir):
    g = _grid(spark, sf_dir).where("s > 40")
    points = g.select((F.col("y") * 50 + F.col("x")).cast("long").alias("p_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    k = F.col("s_suppkey")
    targets = table(spark, sf_dir, "supplier").select(k.alias("t_id"), ((k % 10) * 5 + 0.37).alias("x"), (F.floor(k / 10) * 4 + 0.61).alias("y"))
    return joins.nearest_in_radius(points, targets, 1.8).select("t_id", "p_id", F.round("distance", 7).alias("distance"))


_WIN = "w AS (SELECT *, unnest(generate_series(0, {n})) AS wy FROM g), ww AS (SELECT w.*, unnest(generate_series(0, {m})) AS wx FROM w WHERE wy <= y AND y < wy + {k}), z AS (SELECT * FROM ww WHERE wx <= x AND x < wx + {k})"


def _win(k, stride=1):
    """Windows of the raster that lie inside it wholly."""
    return f", e AS (SELECT max(y) + 1 AS h FROM g), a AS (SELECT g.*, unnest(generate_series(greatest(0, y - {k} + 1), y)) AS wy FROM g), b AS (SELECT a.*, unnest(generate_series(greatest(0, x - {k} + 1), x)) AS wx FROM a), z AS (SELECT b.* FROM b, e WHERE wy % {stride} = 0 AND wx % {stride} = 0 AND wy + {k} <= h AND wx + {k} <= 50)"


@query(_G + _win(5) + ", s2 AS (SELECT wy, wx, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM z GROUP BY 1, 2) SELECT y, x, round(avg(CASE WHEN sd <= 1e-12 THEN 0 ELSE (v - m) / sd END), 6) AS z FROM z JOIN s2 USING (wy, wx) WHERE n >= 2 GROUP BY 1, 2")
def z04_local_z(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return zscore.local_zscore(g, "v", 5, 1, _height(g), WIDTH).withColumn("z", F.round("z", 6))


@query(_G + _win(7, 2) + ", i AS (SELECT *, greatest(abs(y - wy - 3), abs(x - wx - 3)) <= 1 AS inner_ FROM z), s2 AS (SELECT wy, wx, avg(v) FILTER (WHERE NOT inner_) AS m, stddev_pop(v) FILTER (WHERE NOT inner_) AS sd, count(*) FILTER (WHERE NOT inner_) AS n FROM i GROUP BY 1, 2) SELECT y, x, round(avg((v - m) / sd), 6) AS z FROM i JOIN s2 USING (wy, wx) WHERE inner_ AND n >= 5 AND sd > 1e-6 GROUP BY 1, 2")
def z05_annular_z(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return zscore.annular_zscore(g, "v", 7, 3, 2, _height(g), WIDTH).withColumn("z", F.round("z", 6))


@query(_G + _win(3) + ", m AS (SELECT wy, wx, avg(v) AS m1, avg(s * 1e1) AS m2 FROM z GROUP BY 1, 2), d AS (SELECT wy, wx, avg(sqrt(pow(v - m1, 2) + pow(s * 1e1 - m2, 2))) AS d FROM z JOIN m USING (wy, wx) GROUP BY 1, 2) SELECT y, x, round(avg(d), 6) AS msd FROM z JOIN d USING (wy, wx) GROUP BY 1, 2")
def win06_msd(spark, sf_dir):
    g = _grid(spark, sf_dir)
    rows = g.select("y", "x", F.array("v", F.col("s") * 10.0).alias("spectrum"))
    return raster.mean_spectral_distance(rows, "spectrum", 3, 1, _height(g), WIDTH).withColumn("msd", F.round("msd", 6))


@query(_G + _win(3) + ", m AS (SELECT wy, wx, avg(v) AS m, count(*) AS n FROM z GROUP BY 1, 2 HAVING count(*) = 9) SELECT y, x, round(m, 6) AS mean FROM (SELECT g.y, g.x, avg(m.m) AS m FROM g LEFT JOIN z USING (y, x) LEFT JOIN m USING (wy, wx) GROUP BY 1, 2)")
def win02_box_mean(spark, sf_dir):
    """Overlap average by running sums: no window is materialised."""
    g = _grid(spark, sf_dir)
    return raster.box_mean(g, "v", 3, _height(g), WIDTH).select("y", "x", F.round("mean", 6).alias("mean"))


@query(_G + _win(8, 2) + ", q AS (SELECT wy, wx, count(*) FILTER (WHERE s < 45) / 64e0 AS share, round(coalesce(var_pop(v) FILTER (WHERE s < 45), 0), 6) AS variance FROM z GROUP BY 1, 2) SELECT CAST(wy AS INTEGER) AS wy, CAST(wx AS INTEGER) AS wx, share, variance FROM q WHERE share >= 65e-2 ORDER BY share DESC, variance DESC, wy, wx LIMIT 1")
def win08_best_window(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return raster.best_window(g, "v", F.col("s") < 45, 8, 2, _height(g), WIDTH, 0.65)


@query("SELECT p_partkey, CAST(round_even((p_retailprice - 9e2) / 3e1, 0) AS INTEGER) AS px, round(9e2 + (CAST(round_even((p_retailprice - 9e2) / 3e1, 0) AS INTEGER) + 5e-1) * 3e1, 6) AS centre FROM part")
def mos07_pixel_of_coordinate(spark, sf_dir):
    px = raster.to_pixel(F.col("p_retailprice"), 900.0, 30.0)
    return table(spark, sf_dir, "part").select("p_partkey", px.alias("px"), F.round(raster.to_coordinate(px, 900.0, 30.0), 6).alias("centre"))
