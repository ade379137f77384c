"""Scalar functions, masks and predicates on the stand-in tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import qa, spectral, time
from ..functions._clip import clip
from .registry import query, table


@query("""SELECT o_orderkey, round(year(o_orderdate) + CAST(epoch_us(o_orderdate) - epoch_us(make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0)) AS DOUBLE)
 / (epoch_us(make_timestamp(year(o_orderdate) + 1, 1, 1, 0, 0, 0)) - epoch_us(make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0))), 8) AS frac_year FROM orders""")
def fn01_fractional_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(time.fractional_year(F.col("o_orderdate")), 8).alias("frac_year"))


@query("SELECT o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25e0, 8) AS approx_year FROM orders")
def fn02_approximate_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(time.approximate_year(F.col("o_orderdate")), 8).alias("approx_year"))


@query("""SELECT event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / (365.25e0 * 86400e0 * 1e6), 9) AS rel_year FROM events""")
def fn03_relative_years(spark, sf_dir):
    from pyspark.sql import Window

    first = F.min("ts").over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.round(time.relative_years(F.col("ts"), first), 9).alias("rel_year"))


@query("""WITH f AS (SELECT o_orderkey, year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25e0 AS fy FROM orders)
 SELECT o_orderkey, printf('%04d-%02d', CAST(floor(fy) AS INTEGER), CAST(least(12, floor((fy - floor(fy)) * 12) + 1) AS INTEGER)) AS ym FROM f""")
def fn04_year_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", time.year_month(time.approximate_year(F.col("o_orderdate"))).alias("ym"))


@query("""SELECT event_id, round(sin(2 * pi() * dayofyear(ts) / 365.25e0), 9) AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25e0), 9) AS doy_cos,
 round(sin(2 * pi() * ((epoch_us(ts) % 86400000000) / 8.64e10)), 9) AS tod_sin, round(cos(2 * pi() * ((epoch_us(ts) % 86400000000) / 8.64e10)), 9) AS tod_cos FROM events""")
def fn05_doy_tod_features(spark, sf_dir):
    ds, dc = time.cyclic(time.day_of_year_phase(F.col("ts")))
    ts, tc = time.cyclic(time.time_of_day_phase(F.col("ts")))
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 9).alias(n) for c, n in ((ds, "doy_sin"), (dc, "doy_cos"), (ts, "tod_sin"), (tc, "tod_cos"))])


@query("""WITH u AS (SELECT event_id, unnest(range(0, 10)) AS i, value / 500e0 AS v FROM events)
 SELECT event_id, CAST(i AS INTEGER) AS octave, round(sin(pow(2e0, i) * pi() * v), 7) AS s, round(cos(pow(2e0, i) * pi() * v), 7) AS c FROM u""")
def fn06_fourier_features(spark, sf_dir):
    feats = time.fourier_features(F.col("value") / 500.0)
    rows = table(spark, sf_dir, "events").select("event_id", feats.alias("f")).select("event_id", "f", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("octave"))
    at = lambda k: F.round(F.get("f", F.col("octave") * 2 + k), 7)
    return rows.select("event_id", "octave", at(0).alias("s"), at(1).alias("c"))


@query("""WITH d AS (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 8.64e10 AS dt FROM events)
 SELECT event_id, round(sin(2 * pi() * dt / 365.25e0), 9) AS y_sin, round(cos(2 * pi() * dt / 365.25e0), 9) AS y_cos, round(sin(2 * pi() * dt / 7e0), 9) AS w_sin, round(cos(2 * pi() * dt / 7e0), 9) AS w_cos,
 round(1 - exp(-1e-1 * dt), 9) AS weight FROM d""")
def fn07_fn08_interval_features(spark, sf_dir):
    """Harmonics of the time since the last observation, and its weight."""
    from ..operators import series

    rows = series.intervals(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], time.micros(F.col("ts")), "dt_us").withColumn("dt", F.col("dt_us") / 8.64e10)
    ys, yc = time.cyclic(F.col("dt") / 365.25)
    ws, wc = time.cyclic(F.col("dt") / 7.0)
    return rows.select("event_id", *[F.round(c, 9).alias(n) for c, n in ((ys, "y_sin"), (yc, "y_cos"), (ws, "w_sin"), (wc, "w_cos"), (time.decay_weight(F.col("dt"), 0.1), "weight"))])


@query("SELECT event_id, greatest(-5e0, least(5e0, (value - 100) / 20e0)) AS z5, greatest(-6e0, least(6e0, (value - 100) / 20e0)) AS z6 FROM events")
def fn09_clipped_scores(spark, sf_dir):
    z = (F.col("value") - 100) / 20.0
    return table(spark, sf_dir, "events").select("event_id", clip(z, -5.0, 5.0).alias("z5"), clip(z, -6.0, 6.0).alias("z6"))


@query("""WITH w AS (SELECT event_id, epoch_us(ts) AS t, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS lo, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS hi FROM events)
 SELECT event_id, round((t - lo) / nullif(CAST(hi - lo AS DOUBLE), 0), 9) AS t01, round(pi() * (2 * ((t - lo) / nullif(CAST(hi - lo AS DOUBLE), 0)) - 1), 9) AS t_pi FROM w""")
def fn10_time_range(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    t = time.micros(F.col("ts"))
    share = (t - F.min(t).over(w)) / F.nullif((F.max(t).over(w) - F.min(t).over(w)).cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(share, 9).alias("t01"), F.round(math.pi * (2 * share - 1), 9).alias("t_pi"))


@query("""SELECT p_partkey, round(nullif(p_size, 50) * 1e-4, 9) AS hls, round(greatest(p_size * 2.75e-5 - 2e-1 + p_retailprice * 1e-4, 0e0), 9) AS landsat, round(p_size * 1e-2, 9) AS angle FROM part""")
def fn11_scale_offset(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(spectral.scaled(size, 1e-4, fill=50.0), 9).alias("hls"),
        F.round(F.greatest(spectral.scaled(size, 2.75e-5, -0.2) + F.col("p_retailprice") * 1e-4, F.lit(0.0)), 9).alias("landsat"),
        F.round(spectral.scaled(size, 0.01), 9).alias("angle"),
    )


@query("""WITH d AS (SELECT o_orderkey, 1 - 1.672e-2 * cos(radians(9.856e-1 * (dayofyear(o_orderdate) - 4))) AS d, o_totalprice / 1e3 AS l, (o_custkey % 89 + 40) AS z FROM orders)
 SELECT o_orderkey, round(d, 9) AS distance, round(CASE WHEN z <> 90 AND cos(radians(z)) > 0 THEN pi() * l * d * d / (1500e0 * cos(radians(z))) END, 7) AS toa FROM d""")
def fn12_fn13_toa_reflectance(spark, sf_dir):
    d = spectral.earth_sun_distance(F.dayofyear("o_orderdate"))
    zenith = F.nullif(F.col("o_custkey") % 89 + 40, F.lit(90))
    toa = spectral.toa_reflectance(F.col("o_totalprice") / 1e3, d, F.lit(1500.0), zenith)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(d, 9).alias("distance"), F.round(toa, 7).alias("toa"))


@query("""WITH g AS (SELECT CAST(p_size AS DOUBLE) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1),
 q AS (SELECT l_linenumber, l_quantity + 5e-1 AS x, count(*) AS n FROM lineitem GROUP BY 1, 2),
 a AS (SELECT q.*, (SELECT max(x) FROM g WHERE g.x <= q.x) AS x0, (SELECT min(x) FROM g WHERE g.x >= q.x) AS x1 FROM q)
 SELECT l_linenumber, a.x, n, round(CASE WHEN x0 IS NULL THEN g1.y WHEN x1 IS NULL OR x0 = x1 THEN g0.y ELSE g0.y + (g1.y - g0.y) * (a.x - x0) / (x1 - x0) END, 6) AS y
 FROM a LEFT JOIN g g0 ON g0.x = x0 LEFT JOIN g g1 ON g1.x = x1""")
def fn14_linear_interpolation(spark, sf_dir):
    """Interpolates a sampled curve at given places, flat beyond its ends."""
    from ..operators import joins

    curve = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    at = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", (F.col("l_quantity") + 0.5).alias("x")).agg(F.count("*").alias("n"))
    return joins.interpolate(at, curve, "x", "y").select("l_linenumber", "x", "n", F.round("y", 6).alias("y"))


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_discount * l_extendedprice - l_tax AS y, l_tax - 1e0 * l_discount AS c FROM lineitem)
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, round(CASE WHEN abs(1 + c * y) > 1e-6 THEN y / (1 + c * y) ELSE 0e0 END, 5) AS sr FROM s""")
def fn15_correction_coefficients(spark, sf_dir):
    sr = spectral.surface_reflectance(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), F.col("l_tax") - 1.0 * F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", F.round(sr, 5).alias("sr"))


@query("""SELECT p_partkey, round((p_retailprice / 1e3) * pow(550e0 / 440e0, ln((p_retailprice / 1e3) / (p_size / 1e1)) / ln(440e0 / 870e0)), 7) AS aod FROM part""")
def fn17_angstrom_depth(spark, sf_dir):
    aod = spectral.angstrom(F.col("p_retailprice") / 1e3, 440.0, F.col("p_size") / 10.0, 870.0, 550.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(aod, 7).alias("aod"))


@query("""WITH p AS (SELECT *, lag(n_nationkey) OVER (ORDER BY n_nationkey) AS k FROM nation)
 SELECT n_nationkey, round(2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians(3e0 * (n_nationkey - k)) / 2), 2) + cos(radians(3e0 * k)) * cos(radians(3e0 * n_nationkey)) * pow(sin(radians(7e0 * (n_nationkey - k)) / 2), 2)))), 3) AS metres,
 round(3e0 * (n_nationkey - k) * 111320e0, 3) AS dy, round(7e0 * (n_nationkey - k) * 111320e0 * cos(radians(3e0 * k)), 3) AS dx FROM p""")
def fn20_fn21_distances(spark, sf_dir):
    from pyspark.sql import Window

    k = F.lag("n_nationkey").over(Window.orderBy("n_nationkey"))  # one row a nation
    rows = table(spark, sf_dir, "nation").select("n_nationkey", k.alias("k"))
    lat, lon = lambda c: F.col(c) * 3.0, lambda c: F.col(c) * 7.0
    dy, dx = spectral.degrees_to_metres(lat("n_nationkey") - lat("k"), lon("n_nationkey") - lon("k"), lat("k"))
    m = spectral.haversine(lat("k"), lon("k"), lat("n_nationkey"), lon("n_nationkey"))
    return rows.select("n_nationkey", F.round(m, 3).alias("metres"), F.round(dy, 3).alias("dy"), F.round(dx, 3).alias("dx"))


@query("""WITH s AS (SELECT p_brand, quantile_cont(p_retailprice, 2e-2) AS lo, quantile_cont(p_retailprice, 98e-2) AS hi FROM part GROUP BY 1)
 SELECT p_partkey, CAST(trunc(255 * pow(greatest(0e0, least(1e0, (p_retailprice - lo) / nullif(hi - lo, 0))), 1 / 1.2e0)) AS INTEGER) AS gray FROM part JOIN s USING (p_brand)""")
def fn22_rgba_stretch(spark, sf_dir):
    from ..operators import raster

    return raster.stretch(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 2, 98, gamma=1.2, out="gray").select("p_partkey", "gray")


@query("""WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
 SELECT p_partkey, round((p_retailprice - lo) / nullif(hi - lo, 0), 9) AS lin, round(ln(1 + p_retailprice - lo) / nullif(ln(1 + hi - lo), 0), 9) AS lg FROM part, s""")
def fn24_normalise(spark, sf_dir):
    from ..operators import raster

    rows = raster.normalise(table(spark, sf_dir, "part"), [], "p_retailprice", out="lin")
    rows = raster.normalise(rows, [], "p_retailprice", log=True, out="lg")
    return rows.select("p_partkey", F.round("lin", 9).alias("lin"), F.round("lg", 9).alias("lg"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, round(299e-3 * l_quantity + 587e-3 * l_discount + 114e-3 * l_tax, 9) AS lum FROM lineitem""")
def fn26_luminance(spark, sf_dir):
    lum = spectral.luminance(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", F.round(lum, 9).alias("lum"))


@query("""WITH s AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events)
 SELECT event_id, round(value - coalesce(p, l), 6) AS diff FROM s""")
def fn27_cyclic_difference(spark, sf_dir):
    """Difference to the frame before; the first one to the last."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") - F.coalesce(F.lag("value").over(w), last), 6).alias("diff"))


@query("SELECT p_partkey, CASE WHEN p_retailprice / 1e1 < 100 THEN p_retailprice / 1e1 * 1000 ELSE p_retailprice / 1e1 END AS nm FROM part")
def fn28_unit_unification(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", spectral.to_nanometres(F.col("p_retailprice") / 10.0).alias("nm"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS head, regexp_extract(p_brand, '([0-9]+)', 1) AS num, starts_with(p_type, 'S') AS s, replace(p_type, ' ', '_') AS t, printf('%05d_%s', p_partkey, p_brand) AS label FROM part""")
def fn29_strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.split("p_name", " ")[0].alias("head"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"),
        F.startswith("p_type", F.lit("S")).alias("s"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("t"), F.format_string("%05d_%s", "p_partkey", "p_brand").alias("label"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, to_json({'id': event_id, 'k': CAST(json_extract_string(props, '$.k') AS INTEGER)}) AS js FROM events")
def fn30_json(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("js"))


@query("""SELECT vec_id, list_max(embedding) AS mx, list_position(embedding, list_max(embedding)) - 1 AS argmax, len(list_filter(embedding, lambda x: x > 0)) AS n_pos, embedding[3:5] AS part, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 6) AS total FROM embeddings""")
def fn31_arrays(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_max(e).alias("mx"), (F.array_position(e, F.array_max(e)) - 1).alias("argmax"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("n_pos"),
        F.slice(e, 3, 3).alias("part"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"),
    )


@query("""WITH g AS (SELECT p_brand, list(DISTINCT CAST(p_size AS DOUBLE) ORDER BY CAST(p_size AS DOUBLE)) AS w FROM part GROUP BY 1),
 s AS (SELECT p_brand, w, i, (w[least(i + 1, len(w))] - w[greatest(i - 1, 1)]) / (least(i + 1, len(w)) - greatest(i - 1, 1)) AS d FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM g))
 SELECT p_brand, CAST(i - 1 AS INTEGER) AS pos, round(d / sum(d) OVER (PARTITION BY p_brand), 9) AS weight FROM s""")
def fn32_wavelength_weights(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.col("p_size").cast("double"))).alias("w"))
    return g.select("p_brand", F.posexplode(spectral.wavelength_weights(F.col("w"))).alias("pos", "weight")).withColumn("weight", F.round("weight", 9))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, round(greatest(-1e0, least(1e0, (l_quantity - l_discount * 100) / nullif(l_quantity + l_discount * 100, 0))), 9) AS ndvi,
 round(greatest(-1e0, least(1e0, (l_tax * 100 - l_quantity) / nullif(l_tax * 100 + l_quantity, 0))), 9) AS ndbi FROM lineitem""")
def spx24_spx25_normalised_indices(spark, sf_dir):
    nir, red, swir = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", F.round(spectral.ndvi(red, nir), 9).alias("ndvi"), F.round(spectral.ndbi(swir, nir), 9).alias("ndbi"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, round(2.5e0 * (l_quantity / 5e1 - l_discount) / nullif(l_quantity / 5e1 + 6e0 * l_discount - 7.5e0 * l_tax + 1e0, 0), 7) AS evi FROM lineitem""")
def spx26_evi(spark, sf_dir):
    evi = spectral.evi(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 50.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", F.round(evi, 7).alias("evi"))


@query("""SELECT vec_id, embedding[3] AS red, embedding[70] AS absent FROM embeddings""")
def spx25_missing_band(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", spectral.band(e, 2).alias("red"), spectral.band(e, 69).alias("absent"))


@query("""WITH u AS (SELECT vec_id, unnest(range(1, 7)) AS i, list_transform(embedding[1:6], lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings)
 SELECT vec_id, round(max(v[i] / pow(64e0, i / 2e0)) FILTER (WHERE i >= 3), 12) AS reduced, round(sum(v[i] / pow(64e0, i / 2e0)), 12) AS total FROM u GROUP BY 1""")
def spx15_spx16_norm_and_reduction(spark, sf_dir):
    v = spectral.band_count_norm(F.transform(F.slice("embedding", 1, 6), lambda x: F.abs(x.cast("double"))), 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(spectral.scalar_reduction(v), 12).alias("reduced"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 12).alias("total"))


@query("""WITH c AS (SELECT unnest(range(0, 64)) AS code), v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
 SELECT vec_id, CAST(code AS INTEGER) AS code, round((code & 1) * e[1] + ((code >> 1) & 1) * e[2] + ((code >> 2) & 1) * e[3] + ((code >> 3) & 1) * e[4] + ((code >> 4) & 1) * e[5] + ((code >> 5) & 1) * e[6], 7) AS vertex FROM v, c""")
def spx22_parallelotope_vertices(spark, sf_dir):
    """Sums of all subsets of the spanning vectors (here one component)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 6).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("code"))
    bits = F.transform("e", lambda x, i: x.cast("double") * F.expr("0") + F.when(F.getbit(F.col("code").cast("long"), i.cast("int")) == 1, x.cast("double")).otherwise(0.0))
    return v.select("vec_id", "code", F.round(F.aggregate(bits, F.lit(0.0), lambda s, x: s + x), 7).alias("vertex"))


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(f"""SELECT event_id, (({_K} & 6) <> 0) OR ((({_K} >> 6) & 3) > 1) OR coalesce(90 - nullif(value, 490.02) < 25, true) AS invalid FROM events""")
def msk01_qa_bits(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", qa.hls_invalid(k, F.nullif("value", F.lit(490.02)), reject=6, aerosol="low", min_sun=25.0).alias("invalid"))


@query(f"""SELECT event_id, (value < 20) OR (({_K} & 24) <> 0) OR (user_id % 17 = 0) OR NOT (({_K} & 3) IN (0, 1, 2)) AS invalid FROM events""")
def msk02_landsat_mask(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    saturation = F.when(F.col("user_id") % 17 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", qa.landsat_invalid(k, saturation, k.bitwiseAND(F.lit(3)), F.col("value"), 24, [0, 1, 2], 20.0).alias("invalid"))


@query("""SELECT vec_id, (vec_id % 7 = 0) OR (vec_id % 11 = 0) OR (vec_id % 90 > 65) OR (abs(embedding[1]) >= 0.3::FLOAT::DOUBLE) OR coalesce(list_max(list_transform(range(1, 33), lambda i: CASE WHEN i % 3 <> 0 THEN CAST(embedding[i] AS DOUBLE) END)) >= 3e-1, false) AS invalid FROM embeddings""")
def msk03_hyperspectral_mask(spark, sf_dir):
    e = F.col("embedding")
    good = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: i % 3 != 0)
    bad = qa.hyperspectral_invalid(
        (F.col("vec_id") % 7 == 0).cast("int"), (F.col("vec_id") % 11 == 0).cast("int"), (F.col("vec_id") % 90).cast("double"), F.abs(e[0]).cast("double"),
        F.transform(F.slice(e, 1, 32), lambda x: x.cast("double")), good, 25.0, max_aod=0.30000001192092896, max_uncertainty=0.3,
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", bad.alias("invalid"))


@query(f"""SELECT event_id, NOT (({_K} & 6) <> 0) AS valid FROM events""")
def msk04_inverted_polarity(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", qa.with_polarity(qa.any_bit(k, 6), "valid").alias("valid"))


@query("""SELECT vec_id, len(list_filter(embedding, lambda x: x < -0.25::FLOAT OR x > 0.25::FLOAT)) > 0 AS bad FROM embeddings""")
def msk08_out_of_range(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", qa.out_of_range(F.col("embedding"), -0.25, 0.25).alias("bad"))


@query("""SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND user_id % 5 <> 0""")
def pred01_valid_observations(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("invalid", F.col("user_id") % 5 == 0)
    return df.where(~F.col("invalid") & F.nanvl("value", F.lit(None).cast("double")).isNotNull()).select("event_id", "user_id", "value")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def pred02_date_range(spark, sf_dir):
    days = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").where(days).select("o_orderkey")


@query("""WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')
 SELECT o_custkey, o_orderkey FROM t WHERE (n - 1) % 3 = 0""")
def pred03_train_split(spark, sf_dir):
    """Everything before a date, every third row of each key."""
    from ..operators import series

    early = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return series.chronological(early, ["o_custkey"], ["o_orderdate", "o_orderkey"]).where((F.col("seq") - 1) % 3 == 0).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 100 END, 100) < 85")
def pred06_cloud_cover(spark, sf_dir):
    cloud = F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 100)
    return table(spark, sf_dir, "orders").where(F.coalesce(cloud, F.lit(100)) < 85).select("o_orderkey")


@query("""WITH s AS (SELECT user_id, count(*) FILTER (WHERE value < 100) AS good, count(*) AS n FROM events GROUP BY 1)
 SELECT event_id FROM events JOIN s USING (user_id) WHERE 100e0 * good / n >= 60""")
def pred07_coverage_having(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    enough = df.groupBy("user_id").agg(F.count_if(F.col("value") < 100).alias("good"), F.count("*").alias("n")).where("100 * good / n >= 60")
    return df.join(enough.select("user_id"), "user_id", "left_semi").select("event_id")


@query("SELECT event_type, count(*) FILTER (WHERE value > 100) / CAST(count(*) AS DOUBLE) AS masked FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 100) <= 6e-1 * count(*)")
def pred08_masked_ratio(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count_if(F.col("value") > 100) / F.count("*")).alias("masked"))
    return g.where("masked <= 0.6e0")


@query(f"""SELECT user_id, count(*) FILTER (WHERE {_K} > 1) AS seen, count(*) FILTER (WHERE {_K} > 1 AND ({_K} & 12) <> 0) AS bad FROM events GROUP BY 1
 HAVING count(*) FILTER (WHERE {_K} > 1) > 0 AND 100e0 * count(*) FILTER (WHERE {_K} > 1 AND ({_K} & 12) <> 0) / count(*) FILTER (WHERE {_K} > 1) <= 75""")
def pred09_qa_scene_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(k > 1).alias("seen"), F.count_if((k > 1) & qa.any_bit(k, 12)).alias("bad"))
    return g.where("seen > 0 and 100 * bad / nullif(seen, 0) <= 75")


@query("SELECT user_id FROM events GROUP BY 1 HAVING bool_and(event_type <> 'click' OR value < 400)")
def pred10_all_points(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and((F.col("event_type") != "click") | (F.col("value") < 400)).alias("ok"))
    return g.where("ok").select("user_id")


@query("""WITH t AS (SELECT unnest([10e0, 22.5e0, 49e0]) AS aim), b AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS w, min(p_partkey) AS idx FROM part GROUP BY 1, 2),
 r AS (SELECT p_brand, aim, idx, w, row_number() OVER (PARTITION BY p_brand, aim ORDER BY abs(w - aim), idx) AS n FROM b, t) SELECT p_brand, aim, idx, w FROM r WHERE n = 1""")
def pred11_nearest_band(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("w")).agg(F.min("p_partkey").alias("idx"))
    aims = b.select("*", F.explode(F.array(F.lit(10.0), F.lit(22.5), F.lit(49.0))).alias("aim"))
    best = aims.groupBy("p_brand", "aim").agg(F.min(F.struct(F.abs(F.col("w") - F.col("aim")), "idx", "w")).alias("m"))
    return best.select("p_brand", "aim", "m.idx", "m.w")


@query("SELECT vec_id, embedding[5] AS back5, CAST(NULL AS FLOAT) AS back6, list_filter(list_transform(range(1, 65), lambda i: CASE WHEN i % 4 = 1 THEN embedding[i] END), lambda x: x IS NOT NULL) AS good FROM embeddings")
def pred12_good_bands(spark, sf_dir):
    """Good bands only, and scattered back with nulls."""
    e = F.col("embedding")
    back = F.transform(e, lambda x, i: F.when(i % 4 == 0, x))
    return table(spark, sf_dir, "embeddings").select("vec_id", back[4].alias("back5"), back[5].alias("back6"), F.filter(e, lambda x, i: i % 4 == 0).alias("good"))


@query("""WITH u AS (SELECT label, unnest(range(1, 65)) AS band, unnest(embedding) AS v FROM embeddings) SELECT label, CAST(band - 1 AS INTEGER) AS band FROM u GROUP BY 1, 2 HAVING bool_and(abs(v) < 0.3::FLOAT)""")
def pred13_good_in_all(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("band", "v"))
    limit = F.lit(0.3).cast("float")
    return u.groupBy("label", "band").agg(F.bool_and(F.abs("v") < limit).alias("ok")).where("ok").select("label", "band")


@query("SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 1340 AND 1440 OR p_retailprice BETWEEN 1780 AND 1970 THEN 0e0 ELSE CAST(p_size AS DOUBLE) END AS v FROM part")
def pred14_water_absorption(spark, sf_dir):
    w = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(w.between(1340, 1440) | w.between(1780, 1970), F.lit(0.0)).otherwise(F.col("p_size").cast("double")).alias("v"))


@query("SELECT o_orderkey, ['DJF','MAM','JJA','SON'][CAST(floor((month(o_orderdate) % 12) / 3) AS INTEGER) + 1] AS season FROM orders")
def season_bands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", time.season(F.col("o_orderdate")).alias("season"))
