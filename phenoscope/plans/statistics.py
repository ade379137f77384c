"""Aggregate statistics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import components, series, stats
from .registry import query, table


@query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS frame, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY 1, 2")
def agg01_frame_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("frame")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count("value").alias("n"))


@query("""WITH v AS (SELECT event_type, ln(value) AS x FROM events WHERE value > 0), m AS (SELECT event_type, avg(x) AS mu FROM v GROUP BY 1), c AS (SELECT event_type, mu, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4 FROM v JOIN m USING (event_type) GROUP BY 1, 2)
 SELECT event_type, round(mu, 6) AS mean, round(sqrt(m2), 6) AS sd, round(m3 / pow(m2, 1.5e0), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurt FROM c""")
def agg02_log_moments(spark, sf_dir):
    x = F.ln("value")
    g = table(spark, sf_dir, "events").where("value > 0").groupBy("event_type")
    return g.agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"), F.round(F.skewness(x), 6).alias("skew"), F.round(F.kurtosis(x), 6).alias("kurt"))


@query("""WITH b AS (SELECT event_type, CASE WHEN value = 500 THEN 50 ELSE CAST(floor(value / 10) AS INTEGER) + 1 END AS bin FROM events WHERE value BETWEEN 0 AND 500)
 SELECT event_type, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type) * 10e0), 9) AS density FROM b GROUP BY 1, 2""")
def agg03_density_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 500.0, 50).withColumn("density", F.round("density", 9))


@query("""WITH d AS (SELECT o_custkey, o_orderdate, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))) / 8.64e10 AS delta FROM orders)
 SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, count(delta) AS n FROM d GROUP BY 1""")
def agg04_sampling_interval(spark, sf_dir):
    from ..functions import time

    rows = series.intervals(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], time.micros(F.col("o_orderdate")))
    d = F.col("delta") / 8.64e10
    return rows.groupBy(F.year("o_orderdate").alias("yr")).agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("sd"), F.count(d).alias("n"))


@query("""WITH s AS (SELECT event_type, avg(value) AS m, median(value) AS md, var_pop(value) AS v FROM events GROUP BY 1) SELECT event_type, round(m, 6) AS mean, round(md, 6) AS median, round(v, 4) AS var, round(log10(md / m), 7) AS log_ratio FROM s""")
def agg05_global_stats(spark, sf_dir):
    m, md = F.avg("value"), F.percentile("value", F.lit(0.5))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(m, 6).alias("mean"), F.round(md, 6).alias("median"), F.round(F.var_pop("value"), 4).alias("var"), F.round(F.log10(md / m), 7).alias("log_ratio"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 5) AS scale, round(median(l_extendedprice / l_quantity), 5) AS med_ratio, round(avg(l_extendedprice / l_quantity), 5) AS mean_ratio FROM lineitem GROUP BY 1")
def agg06_scale_factor(spark, sf_dir):
    return stats.scale_factor(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 5)


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 7) AS r, round(regr_r2(l_extendedprice, l_quantity), 7) AS r2,
 round(regr_slope(log10(l_extendedprice), log10(l_quantity)), 7) AS log_slope FROM lineitem GROUP BY 1""")
def agg07_cross_sensor_regression(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.corr(y, x), 7).alias("r"),
        F.round(F.regr_r2(y, x), 7).alias("r2"), F.round(F.regr_slope(F.log10(y), F.log10(x)), 7).alias("log_slope"),
    )


@query("""WITH p AS (SELECT unnest(range(1, 100)) AS p), a AS (SELECT quantile_cont(value, list_transform(range(1, 100), lambda i: i / 100e0)) AS q FROM events WHERE event_type = 'click'), b AS (SELECT quantile_cont(value, list_transform(range(1, 100), lambda i: i / 100e0)) AS q FROM events WHERE event_type <> 'click')
 SELECT CAST(p AS INTEGER) AS p, round(a.q[p], 5) AS qa, round(b.q[p], 5) AS qb FROM p, a, b""")
def agg08_qq_quantiles(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return stats.quantile_pairs(ev.where("event_type = 'click'"), ev.where("event_type <> 'click'"), "value", 5)


@query("""WITH g AS (SELECT user_id, count(*) AS n, median(value) AS m, 2 * 3 * sqrt(avg(value * value)) AS bound, count(*) FILTER (WHERE value > 250) AS bad FROM events GROUP BY 1)
 SELECT round(median(bound), 5) AS med, round(avg(bound), 5) AS mean, round(max(bound), 5) AS mx, round(100e0 * sum(bad) / sum(n), 7) AS pct FROM g""")
def agg10_configuration_summary(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), (6 * F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("bound"), F.count_if(F.col("value") > 250).alias("bad"))
    return g.agg(F.round(F.percentile("bound", F.lit(0.5)), 5).alias("med"), F.round(F.avg("bound"), 5).alias("mean"), F.round(F.max("bound"), 5).alias("mx"), F.round(100 * F.sum("bad") / F.sum("n"), 7).alias("pct"))


@query("""WITH c AS (SELECT p_brand, round(p_retailprice / 100) AS v, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT p_brand, v, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, v) AS k FROM c) SELECT p_brand, v AS mode, n FROM r WHERE k = 1""")
def agg11_mode_smallest(spark, sf_dir):
    """Most frequent rounded value, the smallest of equals."""
    return stats.mode(table(spark, sf_dir, "part").withColumn("v", F.round(F.col("p_retailprice") / 100)), ["p_brand"], "v")


@query("SELECT user_id, max(value) AS top, round(avg(value), 6) AS mean, max_by(event_type, {'v': value, 'i': -event_id}) AS dominant FROM events GROUP BY 1")
def agg12_dominant(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("event_type", F.struct("value", -F.col("event_id"))).alias("dominant"))


@query("SELECT user_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 10")
def agg13_valid_pixels(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.count("*").alias("n"))
    return g.where("n >= 10")


@query("""WITH d AS (SELECT l_returnflag, CASE WHEN l_discount > 0 THEN abs(l_tax - l_discount) / l_discount END AS rel, l_tax = l_discount AS same FROM lineitem)
 SELECT l_returnflag, round(max(rel), 7) AS mx, round(avg(rel), 7) AS mean, round(median(rel), 7) AS med, round(quantile_cont(rel, 95e-2), 7) AS p95, round(quantile_cont(rel, 99e-2), 7) AS p99, count(*) FILTER (WHERE same) AS exact FROM d GROUP BY 1""")
def agg14_relative_differences(spark, sf_dir):
    return stats.difference_report(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_discount", 7)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS pct FROM events GROUP BY 1")
def agg15_stage_shares(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.sum("value").alias("s"))
    return g.select("event_type", "mean", F.round(100 * F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("pct"))  # one row a stage


@query("""WITH m AS (SELECT event_type, avg(value) AS p FROM events GROUP BY 1) SELECT user_id, round(sqrt(sum(pow(value - p, 2)) / count(*)), 6) AS rmse, round(avg(abs(value - p)), 6) AS mae FROM events JOIN m USING (event_type) GROUP BY 1""")
def agg16_residual_sums(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    rows = ev.join(ev.groupBy("event_type").agg(F.avg("value").alias("p")), "event_type")
    r = F.col("value") - F.col("p")
    return rows.groupBy("user_id").agg(F.round(F.sqrt(F.avg(r * r)), 6).alias("rmse"), F.round(F.avg(F.abs(r)), 6).alias("mae"))


@query("WITH t AS (SELECT quantile_cont(value, 8e-1) AS q FROM events) SELECT event_id, value > q AS flag FROM events, t")
def agg17_contamination_flag(spark, sf_dir):
    return stats.contamination(table(spark, sf_dir, "events"), "value", 0.2).select("event_id", "flag")


@query("""WITH u AS (SELECT vec_id, CAST(floor((unnest(range(0, 64))) / 16) AS INTEGER) AS grp, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), g AS (SELECT vec_id, grp, avg(v) AS mean, max(abs(v)) AS top FROM u GROUP BY 1, 2)
 SELECT vec_id, grp, round(mean, 8) AS mean, round(top, 8) AS top, round(top / sum(top) OVER (PARTITION BY vec_id), 8) AS frac FROM g""")
def agg18_attribution_groups(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 16).cast("int").alias("grp"), F.col("v").cast("double").alias("v"))
    g = u.groupBy("vec_id", "grp").agg(F.avg("v").alias("mean"), F.max(F.abs("v")).alias("top"))
    return g.select("vec_id", "grp", F.round("mean", 8).alias("mean"), F.round("top", 8).alias("top"), F.round(F.col("top") / F.sum("top").over(Window.partitionBy("vec_id")), 8).alias("frac"))


@query("WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT user_id, round(greatest(1.4826e0 * median(abs(value - m)), 1e-6), 6) AS sigma FROM events JOIN m USING (user_id) GROUP BY 1")
def agg19_mad_sigma(spark, sf_dir):
    return stats.mad_sigma(table(spark, sf_dir, "events"), ["user_id"], "value").withColumn("sigma", F.round("sigma", 6))


@query("""WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) * pow(count(value), -2e-1) AS h FROM events GROUP BY 1),
 c AS (SELECT event_type, floor(value / (500e0 / 4096)) AS c, count(value) AS m, avg(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT unnest(range(0, 51)) * 10e0 AS x)
 SELECT event_type, x AS at, round(sum(m * exp(-pow((x - v) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 8) AS density FROM c JOIN s USING (event_type), g GROUP BY 1, 2""")
def agg09_kernel_density(spark, sf_dir):
    got = stats.kernel_density(table(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 500.0, 51)
    return got.select("event_type", F.col("at"), F.round("density", 8).alias("density"))


@query()
def agg20_mahalanobis(spark, sf_dir):
    """All bands; labels are taken in halves, so that a group has more vectors
    than bands."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("half"), "embedding")
    return components.mahalanobis(rows, ["half"], "vec_id", "embedding").withColumn("distance", F.round("distance", 8))


@query()
def ml09_reconstruction_error(spark, sf_dir):
    """What eight principal components of each half of the labels leave of a vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("half"), "embedding")
    return components.reconstruction_error(rows, ["half"], "vec_id", "embedding", 8).withColumn("error", F.round("error", 10))
