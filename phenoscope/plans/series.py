"""Standardisation, windows over time, grouping and temporal joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time
from ..operators import joins, raster, series, zscore
from .registry import query, table

DAY_US = 86_400_000_000
_Z = "SELECT event_id, round((ln(value) - avg(ln(value)) OVER w) / nullif(stddev_samp(ln(value)) OVER w, 0), 7) AS z FROM events WHERE value > 0 WINDOW w AS (PARTITION BY {keys})"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("us", time.micros(F.col("ts")))


def _z(spark, sf_dir, keys, **options):
    rows = zscore.log_zscore(table(spark, sf_dir, "events").where("value > 0"), "value", keys, **options)
    return rows.select("event_id", F.round("z", 7).alias("z"))


@query(_Z.format(keys="event_type"))
def z01_log_zscore_frame(spark, sf_dir):
    return _z(spark, sf_dir, ["event_type"])


@query("""WITH s AS (SELECT event_type, avg(ln(value)) AS m, stddev_samp(ln(value)) AS s FROM events WHERE value > 0 AND user_id % 4 <> 0 GROUP BY 1)
 SELECT event_id, round((ln(value) - m) / nullif(s, 0), 7) AS z FROM events JOIN s USING (event_type)""")
def z01_log_zscore_scores_masked(spark, sf_dir):
    """Statistics from valid positive rows, scores for every row of a type that
    has any: -inf for a value of 0."""
    ev, valid = table(spark, sf_dir, "events"), F.col("user_id") % 4 != 0
    known = ev.where(valid & (F.col("value") > 0)).select("event_type").distinct()
    rows = zscore.log_zscore(ev.join(known, "event_type", "left_semi"), "value", ["event_type"], valid=valid, score="all")
    return rows.select("event_id", F.round("z", 7).alias("z"))


@query("""WITH c AS (SELECT *, user_id % 3 AS sensor FROM events WHERE value > 0) SELECT event_id, round((ln(value) - avg(ln(value)) OVER w) / nullif(stddev_samp(ln(value)) OVER w, 0), 7) AS z FROM c WINDOW w AS (PARTITION BY sensor)""")
def z02_log_zscore_sensor(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 0").withColumn("sensor", F.col("user_id") % 3)
    return zscore.log_zscore(rows, "value", ["sensor"]).select("event_id", F.round("z", 7).alias("z"))


@query(_Z.format(keys="event_type, user_id"))
def z03_log_zscore_pixel(spark, sf_dir):
    return _z(spark, sf_dir, ["event_type", "user_id"], least=2)


@query(f"WITH z AS ({_Z.format(keys='event_type').replace('event_id,', 'event_id, event_type,')}) SELECT event_type, avg(CAST(abs(z) <= 1.645e0 AS DOUBLE)) AS coverage FROM z GROUP BY 1")
def z06_interval_coverage(spark, sf_dir):
    rows = zscore.log_zscore(table(spark, sf_dir, "events").where("value > 0"), "value", ["event_type"]).withColumn("z", F.round("z", 7))
    return zscore.interval_coverage(rows, ["event_type"], "z")


_RANGE = "OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 432000000000 PRECEDING AND 1 PRECEDING)"


@query(f"SELECT event_id, count(value) {_RANGE} AS n, round(avg(value) {_RANGE}, 6) AS mean FROM events")
def wf02_trailing_window(spark, sf_dir):
    w = series.trailing(["user_id"], "us", 5 * DAY_US)
    return _events(spark, sf_dir).select("event_id", F.count("value").over(w).alias("n"), F.round(F.avg("value").over(w), 6).alias("mean"))


@query("""WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) AS us FROM events), w AS (SELECT event_id, count(value) OVER a AS n1, avg(value) OVER a AS m1, count(value) OVER b AS n2, avg(value) OVER b AS m2, us - min(us) OVER b AS span FROM e
 WINDOW a AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT event_id, CASE WHEN n1 >= 5 THEN n1 WHEN n2 = 5 AND span <= 345600000000 THEN 5 ELSE 0 END AS w_n, round(CASE WHEN n1 >= 5 THEN m1 WHEN n2 = 5 AND span <= 345600000000 THEN m2 END, 6) AS w_mean FROM w""")
def wf03_elastic_window(spark, sf_dir):
    rows = series.elastic(_events(spark, sf_dir), ["user_id"], "us", "value", 2 * DAY_US, 5, 4 * DAY_US)
    return rows.select("event_id", "w_n", F.round("w_mean", 6).alias("w_mean"))


@query("""WITH s AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS g FROM events)
 SELECT event_id, list_concat(list_transform(range(0, 8 - len(g)), lambda i: 0e0), g) AS sequence FROM s""")
def wf05_last_sequence(spark, sf_dir):
    return series.last_sequence(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 8).select("event_id", "sequence")


@query("""WITH s AS (SELECT user_id, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 w AS (SELECT *, unnest(range(0, 40)) AS win FROM s) SELECT user_id, CAST(win AS INTEGER) AS win, count(*) AS n_rows, round(avg(value), 6) AS mean, CAST(floor((min(us) + max(us)) / 2e0) AS BIGINT) AS center
 FROM w WHERE i >= win * 5 AND i < win * 5 + 10 AND win * 5 + 10 <= n GROUP BY 1, 2""")
def wf06_count_windows(spark, sf_dir):
    w = series.count_windows(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 10, 5)
    center = F.floor((F.min("us") + F.max("us")) / 2.0).cast("long")
    return w.groupBy("user_id", "win").agg(F.count("*").alias("n_rows"), F.round(F.avg("value"), 6).alias("mean"), center.alias("center"))


@query("SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS delta FROM events")
def wf07_intervals(spark, sf_dir):
    return series.intervals(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("us")).select("event_id", "delta")


@query("SELECT user_id, min(ts) FILTER (WHERE value > 100) AS first_valid FROM events GROUP BY 1")
def wf08_first_valid(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.when(F.col("value") > 100, F.col("ts"))).alias("first_valid"))


@query("""WITH w AS (SELECT event_id, epoch_us(ts) AS us, count(*) OVER a AS n, min(epoch_us(ts)) OVER a AS lo FROM events WINDOW a AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 864000000000 PRECEDING AND 1 PRECEDING))
 SELECT event_id, round(CASE WHEN n > 0 THEN 2 * ((us - lo) / 8.64e10) / n END, 7) AS nyquist, CASE WHEN n > 0 THEN 7e0 >= 95e-2 * (us - lo) / 8.64e10 OR 7e0 >= 98e-2 * 10 ELSE true END AS rejected FROM w""")
def wf09_pseudo_nyquist(spark, sf_dir):
    w = series.trailing(["user_id"], "us", 10 * DAY_US)
    n, span = F.count("*").over(w), (F.col("us") - F.min("us").over(w)) / 8.64e10
    rows = _events(spark, sf_dir).select("event_id", n.alias("n"), span.alias("span"))
    return rows.select("event_id", F.round(F.when(F.col("n") > 0, 2 * F.col("span") / F.col("n")), 7).alias("nyquist"), F.when(F.col("n") > 0, (7.0 >= 0.95 * F.col("span")) | (F.lit(7.0) >= 9.8)).otherwise(True).alias("rejected"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def srt01_chronological(spark, sf_dir):
    return series.chronological(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", F.col("seq").cast("long").alias("seq"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def grp01_daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def grp02_last_wins(spark, sf_dir):
    """Of scenes with one product id the last stays."""
    return joins.first_of(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""WITH g AS (SELECT event_id, epoch_us(ts) AS us, event_type, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 600000000 THEN 1 ELSE 0 END AS split FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
 s AS (SELECT *, sum(split) OVER (PARTITION BY event_type ORDER BY us, event_id) AS session FROM g) SELECT event_type, CAST(session AS BIGINT) AS session, count(*) AS n, min(us) AS lo, max(us) AS hi FROM s GROUP BY 1, 2""")
def grp03_passes(spark, sf_dir):
    s = series.sessions(_events(spark, sf_dir), ["event_type"], "us", 600_000_000, ["us", "event_id"])
    return s.groupBy("event_type", "session").agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))


@query("SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1")
def grp04_prefix_groups(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.split("p_name", " ")[0].alias("prefix")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@query("SELECT CASE WHEN contains(p_type, 'BRASS') THEN 'brass' WHEN contains(p_type, 'STEEL') THEN 'steel' ELSE 'other' END AS sensor, count(*) AS n FROM part GROUP BY 1")
def grp05_sensor_groups(spark, sf_dir):
    kind = F.when(F.contains("p_type", F.lit("BRASS")), "brass").when(F.contains("p_type", F.lit("STEEL")), "steel").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(kind.alias("sensor")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT split_part('a.b.' || p_brand || '.c', '.', 3) AS tile FROM part")
def grp06_tile_id(spark, sf_dir):
    item = F.concat(F.lit("a.b."), "p_brand", F.lit(".c"))
    return table(spark, sf_dir, "part").select(F.split(item, r"\.")[2].alias("tile")).distinct()


_FUSED = "SELECT 'order' AS grid, o_orderkey AS local_idx, o_orderdate AS ts FROM orders UNION ALL SELECT 'ship' AS grid, l_orderkey * 100 + l_linenumber AS local_idx, min(l_shipdate) AS ts FROM lineitem GROUP BY 1, 2"


def _timeline(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.lit("order").alias("grid"), F.col("o_orderkey").alias("local_idx"), F.col("o_orderdate").alias("ts"))
    b = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("local_idx")).agg(F.min("l_shipdate").alias("ts"))
    return a.unionByName(b.select(F.lit("ship").alias("grid"), "local_idx", "ts"))


@query(f"SELECT grid, local_idx, row_number() OVER (PARTITION BY year(ts) ORDER BY ts, grid, local_idx) AS frame_idx, CAST(year(ts) AS INTEGER) AS y FROM ({_FUSED})")
def jn01_timeline(spark, sf_dir):
    """Sensors fused into one timeline, numbered inside each year."""
    rows = _timeline(spark, sf_dir).withColumn("y", F.year("ts"))
    return series.chronological(rows, ["y"], ["ts", "grid", "local_idx"], "frame_idx").select("grid", "local_idx", F.col("frame_idx").cast("long").alias("frame_idx"), "y")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, o_orderdate, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn02_provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "o_orderdate", "o_orderstatus")


_NEAREST = """WITH a AS (SELECT event_id AS lid, user_id AS u, epoch_us(ts) AS lt FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS rid, user_id AS u, epoch_us(ts) AS rt FROM events WHERE event_type <> 'click'),
 p AS (SELECT lid, rid, abs(lt - rt) AS gap, row_number() OVER (PARTITION BY lid ORDER BY abs(lt - rt), rid) AS n FROM a JOIN b USING (u) WHERE abs(lt - rt) <= 86400000000)
 SELECT lid, rid, gap FROM p WHERE n = 1"""


def _two_sensors(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", "us", "event_type")
    return rows.where("event_type = 'click'").drop("event_type"), rows.where("event_type <> 'click'").drop("event_type")


@query(_NEAREST)
def jn03_nearest_pairs(spark, sf_dir):
    a, b = _two_sensors(spark, sf_dir)
    near = joins.nearest(a, b, "us", "event_id", DAY_US, ["user_id"])
    return near.select(F.col("l_event_id").alias("lid"), F.col("r_event_id").alias("rid"), "gap")


@query()
def jn03_greedy_pairs(spark, sf_dir):
    a, b = _two_sensors(spark, sf_dir)
    return joins.greedy_pairs(a, b, "us", "event_id", DAY_US, ["user_id"])


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS d, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, CAST(ts AS DATE) AS d, avg(value) AS v FROM events WHERE event_type <> 'click' GROUP BY 1, 2),
 j AS (SELECT a.user_id, a.d, a.v AS v1, b.v AS v2, count(*) OVER (PARTITION BY a.d) AS n FROM a JOIN b USING (user_id, d)) SELECT CAST(d AS VARCHAR) AS d, user_id, round(v1, 6) AS v1, round(v2, 6) AS v2, n FROM j WHERE n > 10""")
def jn04_paired_distributions(spark, sf_dir):
    daily = lambda e: table(spark, sf_dir, "events").where(e).groupBy("user_id", F.to_date("ts").alias("d")).agg(F.round(F.avg("value"), 6).alias("v"))
    both = daily("event_type = 'click'").withColumnRenamed("v", "v1").join(daily("event_type <> 'click'").withColumnRenamed("v", "v2"), ["user_id", "d"])
    return both.withColumn("n", F.count("*").over(Window.partitionBy("d"))).where("n > 10").select(F.col("d").cast("string").alias("d"), "user_id", "v1", "v2", "n")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')), event_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n = 1""")
def jn05_closest_frame(spark, sf_dir):
    aim = time.micros(F.lit("2024-01-15").cast("timestamp_ntz"))
    return joins.closest(_events(spark, sf_dir).select("user_id", "event_id", "us"), F.abs(F.col("us") - aim), "event_id", ["user_id"]).select("user_id", "event_id")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS aod FROM events WHERE event_type = 'click' GROUP BY 1),
 t AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), p AS (SELECT t.day, d.day AS used, d.aod, row_number() OVER (PARTITION BY t.day ORDER BY abs(t.day - d.day), d.day) AS n FROM t, d)
 SELECT CAST(day AS VARCHAR) AS day, CAST(used AS VARCHAR) AS used, round(aod, 6) AS aod FROM p WHERE n = 1""")
def jn06_exact_or_nearest_day(spark, sf_dir):
    """The day's value, else the nearest day's; both sides are calendars."""
    ev = table(spark, sf_dir, "events")
    d = ev.where("event_type = 'click'").groupBy(F.to_date("ts").alias("used")).agg(F.avg("value").alias("aod"))
    days = ev.select(F.to_date("ts").alias("day")).distinct()
    calendar = d.agg(F.array_sort(F.collect_list(F.struct("used", "aod"))).alias("c"))  # one entry a day
    best = F.array_min(F.transform("c", lambda x: F.struct(F.abs(F.datediff(F.col("day"), x["used"])).alias("g"), x["used"].alias("used"), x["aod"].alias("aod"))))
    return days.join(F.broadcast(calendar)).select("day", best.alias("b")).select(F.col("day").cast("string").alias("day"), F.col("b.used").cast("string").alias("used"), F.round("b.aod", 6).alias("aod"))


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, least(a.t, b.t) AS first_at FROM (SELECT user_id, min(ts) AS t FROM events WHERE value > 300 GROUP BY 1) a FULL JOIN (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id")
def jn13_earliest_detector(spark, sf_dir):
    first = lambda e, n: table(spark, sf_dir, "events").where(e).groupBy("user_id").agg(F.min("ts").alias(n))
    return first("value > 300", "a").join(first("event_type = 'purchase'", "b"), "user_id", "full").select("user_id", F.least("a", "b").alias("first_at"))


@query("""WITH a AS (SELECT p_brand, avg(p_retailprice) AS v FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT p_brand, avg(p_retailprice) AS v FROM part WHERE p_size >= 25 GROUP BY 1)
 SELECT p_brand, round(CASE WHEN b.v > 1e-3 THEN abs(a.v - b.v) / b.v * 100 END, 6) AS pct FROM a JOIN b USING (p_brand)""")
def jn14_paired_difference(spark, sf_dir):
    mean = lambda e, n: table(spark, sf_dir, "part").where(e).groupBy("p_brand").agg(F.avg("p_retailprice").alias(n))
    both = mean("p_size < 25", "a").join(mean("p_size >= 25", "b"), "p_brand")
    return both.select("p_brand", F.round(F.when(F.col("b") > 1e-3, F.abs(F.col("a") - F.col("b")) / F.col("b") * 100), 6).alias("pct"))


@query("""WITH x AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS i, p_retailprice AS a FROM part WHERE p_brand = 'Brand#11'), y AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS i, p_retailprice AS b FROM part WHERE p_brand = 'Brand#12') SELECT i, a, b FROM x JOIN y USING (i)""")
def jn12_positional_join(spark, sf_dir):
    """Two rasters joined row by row, cut to the shorter one."""
    def side(brand, n):
        rows = table(spark, sf_dir, "part").where(F.col("p_brand") == brand)
        return series.chronological(rows, ["p_brand"], ["p_partkey"], "i").select(F.col("i").cast("long").alias("i"), F.col("p_retailprice").alias(n))

    return side("Brand#11", "a").join(side("Brand#12", "b"), "i")


@query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events WHERE value <= 200 GROUP BY 1, 2")
def mos01_last_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") <= 200, F.col("value")))
    return raster.mosaic(rows, ["user_id", "event_type"], "value", ["event_id"]).where("value is not null")


@query("SELECT user_id, coalesce(min(m) FILTER (WHERE m <> 255), 255) AS m FROM (SELECT user_id, CASE WHEN value < 30 THEN 255 WHEN value < 60 THEN 0 ELSE 1 END AS m FROM events) GROUP BY 1")
def mos02_mask_mosaic(spark, sf_dir):
    m = F.when(F.col("value") < 30, 255).when(F.col("value") < 60, 0).otherwise(1)
    return raster.mosaic_mask(table(spark, sf_dir, "events").select("user_id", m.alias("m")), ["user_id"], "m", 255)


@query("SELECT DISTINCT event_type FROM events")
def agg24_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type").distinct()


@query("SELECT DISTINCT tile FROM (SELECT p_brand AS tile FROM part WHERE p_size < 10 UNION SELECT p_brand FROM part WHERE p_size > 40)")
def set01_tile_union(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_size < 10").select(F.col("p_brand").alias("tile")).union(part.where("p_size > 40").select("p_brand")).distinct()


@query("SELECT grid, count(*) AS n FROM (" + _FUSED + ") GROUP BY 1")
def set02_union_all(spark, sf_dir):
    return _timeline(spark, sf_dir).groupBy("grid").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def set03_difference(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(used, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1, 2 ORDER BY score NULLS LAST, p_brand, p_type LIMIT 15")
def srt03_top_configurations(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("score"))
    return g.orderBy(F.asc_nulls_last("score"), "p_brand", "p_type").limit(15)


@query("""(SELECT p_partkey, p_retailprice, 'top' AS side FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10) UNION ALL (SELECT p_partkey, p_retailprice, 'bottom' AS side FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)""")
def srt04_top_bottom(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    top = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).withColumn("side", F.lit("top"))
    return top.unionByName(p.orderBy("p_retailprice", "p_partkey").limit(10).withColumn("side", F.lit("bottom")))
