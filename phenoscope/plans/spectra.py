"""Extreme spectra, volumes and complexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, complexity, extremes, hulls, stats
from .registry import query, table


def _tiles(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("label is not null")


@query()
def spx01_maxd_tile(spark, sf_dir):
    return extremes.extreme_spectra(_tiles(spark, sf_dir), ["label"], "vec_id", "embedding", 7)


@query()
def spx05_maxd_legacy_clip(spark, sf_dir):
    return extremes.extreme_spectra(extremes.clip_legacy(_tiles(spark, sf_dir), ["label"], "embedding"), ["label"], "vec_id", "embedding", 7)


@query()
def spx06_maxd_unit(spark, sf_dir):
    return extremes.extreme_spectra(_tiles(spark, sf_dir), ["label"], "vec_id", "embedding", 7, unit=True)


@query()
def spx08_maxd_affine_hull(spark, sf_dir):
    return extremes.extreme_spectra(_tiles(spark, sf_dir), ["label"], "vec_id", "embedding", 7, hull=True)


@query("""WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT *, round(list_inner_product(e, e), 9) AS q FROM e),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY q DESC, vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY q, vec_id) AS b FROM n)
 SELECT x.label, x.vec_id AS longest, y.vec_id AS shortest, round(sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e) - pow(list_inner_product(x.e, y.e), 2)), 7) AS area FROM r x JOIN r y ON x.label = y.label WHERE x.a = 1 AND y.b = 1""")
def spx10_first_two_and_area(spark, sf_dir):
    """The longest and the shortest spectrum, and the area they span."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)
    rows = _tiles(spark, sf_dir).select("label", "vec_id", e.alias("e")).withColumn("q", F.round(dot("e", "e"), 9))
    g = rows.groupBy("label").agg(F.min(F.struct((-F.col("q")).alias("k"), "vec_id", "e")).alias("a"), F.min(F.struct("q", "vec_id", "e")).alias("b"))
    a, b = F.col("a.e"), F.col("b.e")
    return g.select("label", F.col("a.vec_id").alias("longest"), F.col("b.vec_id").alias("shortest"), F.round(F.sqrt(dot(a, a) * dot(b, b) - F.pow(dot(a, b), F.lit(2.0))), 7).alias("area"))


@query()
def spx11_volume_curve(spark, sf_dir):
    return extremes.volume_curves(_tiles(spark, sf_dir), ["label"], "vec_id", "embedding", 7)


@query()
def spx10_gram_volume_curve(spark, sf_dir):
    return extremes.volume_curves(_tiles(spark, sf_dir), ["label"], "vec_id", "embedding", 7, gram=True)


@query()
def spx13_localisations(spark, sf_dir):
    """The last volume for each choice of origin."""
    origins = ["zero", "datasetMean", "endmemberMean", "closestToMean", "minEndmember"]
    v = extremes.localised_curves(_tiles(spark, sf_dir), ["label"], "vec_id", "embedding", 6, origins, by_bands=False)
    return v.groupBy("label", "origin").agg(F.max_by("volume", "m").alias("volume")).select("label", "volume", "origin")


@query()
def spx17_frame_volumes(spark, sf_dir):
    """Four frames, dealt by number."""
    rows = _tiles(spark, sf_dir).select((F.col("vec_id") % 4).alias("frame_idx"), "vec_id", F.col("embedding").alias("s"))
    return extremes.volume_curves(rows, ["frame_idx"], "vec_id", "s", 7, "datasetMean")


@query()
def spx19_functional_complexity(spark, sf_dir):
    return complexity.functional_complexity(_tiles(spark, sf_dir), ["label"], "embedding")


@query("""WITH g AS (SELECT label, arg_max(vec_id, embedding[1]) AS hi, max(embedding[1]) AS hv, min(embedding[1]) AS lv FROM embeddings GROUP BY 1) (SELECT label, hv AS v, 'top' AS side FROM g ORDER BY hv DESC LIMIT 3) UNION ALL (SELECT label, lv, 'bottom' FROM g ORDER BY lv LIMIT 3)""")
def spx20_candidate_frames(spark, sf_dir):
    g = _tiles(spark, sf_dir).groupBy("label").agg(F.max(F.col("embedding")[0]).alias("hv"), F.min(F.col("embedding")[0]).alias("lv"))
    top = g.orderBy(F.desc("hv")).limit(3).select("label", F.col("hv").alias("v"), F.lit("top").alias("side"))
    return top.unionByName(g.orderBy("lv").limit(3).select("label", F.col("lv").alias("v"), F.lit("bottom").alias("side")))


_FRAMES = "g AS (SELECT p_partkey // 400 AS frame, p_partkey % 400 // 20 AS y, p_partkey % 20 AS x, CAST(p_retailprice * p_size AS DOUBLE) AS v, p_size % 17 = 0 AS bad, p_size % 2 AS kind FROM part)"


def _frames(spark, sf_dir):
    """Frames of 20 x 20 parts."""
    k = F.col("p_partkey")
    at = table(spark, sf_dir, "part").select(F.floor(k / 400).alias("frame"), F.floor(k % 400 / 20).alias("y"), (k % 20).alias("x"), (F.col("p_retailprice") * F.col("p_size")).cast("double").alias("v"), (F.col("p_size") % 17 == 0).alias("bad"), (F.col("p_size") % 2).alias("kind"))
    return at


@query(f"""WITH {_FRAMES}, c AS (SELECT * FROM g a WHERE NOT bad AND y BETWEEN 2 AND 17 AND x BETWEEN 2 AND 17 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.bad AND b.frame = a.frame AND (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) < 25e-1 * 25e-1)),
 e AS (SELECT frame, max({{'v': v, 'y': -y, 'x': -x}}) AS hi, min({{'v': v, 'y': y, 'x': x}}) AS lo FROM c GROUP BY 1),
 f AS (SELECT frame, -hi.y AS y, -hi.x AS x, hi.v AS v FROM e UNION SELECT frame, lo.y, lo.x, lo.v FROM e),
 r AS (SELECT *, 'high' AS side, row_number() OVER (ORDER BY v DESC, frame, y, x) AS rank FROM f UNION ALL SELECT *, 'low', row_number() OVER (ORDER BY v, frame, y, x) FROM f)
 SELECT frame, y, x, v, side, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def spx20_extreme_pixels(spark, sf_dir):
    """The highest and lowest values of all frames, away from masks and edges."""
    return candidates.frame_extremes(_frames(spark, sf_dir), ["frame"], "v", "bad", 20, 20, separation=2.5, chip=4, top=10)


_PLACES = """h AS (SELECT y0 AS y, x0 AS x, kind, CAST('0x' || sha256('7:' || y0 || ':' || x0)[1:12] AS BIGINT) AS h FROM (SELECT p_partkey // 50 AS y0, p_partkey % 50 AS x0, p_size % 3 AS kind FROM part)),
 p AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY h, y, x) AS INTEGER) AS patch FROM h)"""


@query(f"""WITH {_PLACES}, q AS (SELECT p_partkey // 50 AS py, p_partkey % 50 AS px, CAST(p_retailprice AS DOUBLE) AS v FROM part)
 SELECT kind, patch, y, x, py - y AS dy, px - x AS dx, v FROM p JOIN q ON py BETWEEN y AND y + 7 AND px BETWEEN x AND x + 7 WHERE patch <= 40""")
def src24_balanced_patches(spark, sf_dir):
    """Forty patches of 8 x 8 pixels of each class, drawn from the whole raster."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("y"), (k % 50).alias("x"), F.col("p_retailprice").cast("double").alias("v"), (F.col("p_size") % 3).alias("kind"))
    places = candidates.draw_places(rows, "kind", 40, seed=7)
    return candidates.patches(rows.drop("kind"), places, 8)


@query()
def spx23_principal_components(spark, sf_dir):
    """First three principal components by Spark ML."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _tiles(spark, sf_dir).select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=3, inputCol="v", outputCol="p").fit(rows)
    return model.transform(rows).select("vec_id", vector_to_array("p").alias("p"))


_ENDS = "p AS (SELECT p_brand AS k, CAST(p_size AS BIGINT) AS x, CAST(round(p_retailprice * 100) AS BIGINT) AS y, p_partkey AS id FROM part), e AS (SELECT k, x, max(y) AS hi, min(y) AS lo FROM p GROUP BY 1, 2), r AS (SELECT k, min(x) AS x0, max(x) AS x1 FROM e GROUP BY 1)"


def _no_chord(end: str, sign: str) -> str:
    """No chord between points on both sides passes the point or leaves it inside."""
    return f"NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.k = b.k WHERE a.k = e.k AND a.x < e.x AND b.x > e.x AND (b.{end} - a.{end}) * (e.x - a.x) {sign} (e.{end} - a.{end}) * (b.x - a.x))"


@query(f"""WITH {_ENDS}, c AS (SELECT e.k, e.x, e.hi AS y FROM e JOIN r USING (k) WHERE {_no_chord("hi", ">=")} UNION SELECT e.k, e.x, e.lo FROM e JOIN r USING (k) WHERE {_no_chord("lo", "<=")})
 SELECT k AS p_brand, min(id) AS p_partkey, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM c JOIN p USING (k, x, y) GROUP BY 1, 3, 4""")
def spx23_hull_corners(spark, sf_dir):
    """Corners of the convex hulls of sizes and prices (in cents), by brand."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("x"), F.round(F.col("p_retailprice") * 100).cast("long").alias("y"))
    return hulls.convex_hulls(rows, ["p_brand"], "p_partkey", "x", "y").drop("corner")


@query()
def spx23_hulls_of_components(spark, sf_dir):
    """Hulls, label by label, of the vectors on their first two principal components."""
    p = spx23_principal_components(spark, sf_dir).join(_tiles(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return hulls.convex_hulls(p.select("label", "vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")), ["label"], "vec_id", "x", "y")


@query()
def fn19_smoothed_spectra(spark, sf_dir):
    return complexity.smoothed_spectra(_tiles(spark, sf_dir), "vec_id", "embedding")


def _grid(spark, sf_dir, side=40, height=None):
    """A raster of spectra: vector ``n`` at row ``n div side`` of one tall frame,
    or of the next frame after every ``height`` rows."""
    n = F.col("vec_id")
    frame, at = (F.floor(n / (side * height)), n % (side * height)) if height else (F.lit(0).cast("long"), n)
    return table(spark, sf_dir, "embeddings").select(frame.alias("frame"), F.floor(at / side).cast("int").alias("y"), (at % side).cast("int").alias("x"), F.col("embedding").alias("s"))


@query()
def win01_tile_complexity(spark, sf_dir):
    return complexity.tile_complexity(_grid(spark, sf_dir, 20), ["frame"], "s", 4, 7)


@query()
def win02_sliding_complexity(spark, sf_dir):
    return complexity.sliding_complexity(_grid(spark, sf_dir, 20, 25), ["frame"], "s", 3, 1, 7, 25, 20, band_rows=8)


@query()
def win04_sliding_use_rest(spark, sf_dir):
    rows = _grid(spark, sf_dir, 20, 25).withColumn("s", F.when((F.col("y") != 5) | (F.col("x") != 5), F.col("s")))
    return complexity.sliding_complexity(rows, ["frame"], "s", 3, 1, 7, 25, 20, band_rows=8, on_invalid="use_rest")
