"""Streams over landed files, worked through by the available-now trigger; their
rows are those of the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time
from ..operators._tables import scratch
from ..streaming import drift, files
from . import detection  # noqa: F401  its SQL is used below
from .registry import ORACLE_SQL, query, table


def _landed(spark, sf_dir, columns, keys=("user_id",)):
    """All events as three drops, in order of time, and a stream over them."""
    rows = table(spark, sf_dir, "events").select(*keys, "ts", "event_id", *columns)
    folder = scratch(rows, "landing")
    files.land(rows, folder, "ts", 3)
    return files.stream_of(spark, folder, rows.schema)


def _appended(stream):
    return files.append_available(stream, scratch(stream, "appended"), scratch(stream, "progress"))


@query(f"SELECT user_id, event_id, status FROM ({ORACLE_SQL['det06_ema_drift']})")
def stream_drift_statuses(spark, sf_dir):
    """The adaptive baseline of each key on a stream, its state carried from
    drop to drop."""
    score = F.when(F.col("event_id") % 7 != 0, F.col("value") / 100).alias("score")
    return _appended(files.drift_states(_landed(spark, sf_dir, [score]), "user_id", "ts", "event_id", "score"))


@query("""WITH e AS (SELECT event_type, epoch_us(ts) AS us, value FROM events)
 SELECT event_type, us // 3600000000 * 3600000000 AS start_us, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY 1, 2
 HAVING start_us + 3600000000 <= (SELECT max(us) // 1000 * 1000 - 86400000000 FROM e)""")
def stream_hourly_sums(spark, sf_dir):
    """Sums of each type and hour that the watermark, a day behind, has passed."""
    stream = _landed(spark, sf_dir, ["value"], keys=("event_type",))
    out = _appended(files.hourly(stream, "ts", F.col("value"), "1 day", keys=["event_type"]))
    return out.select("event_type", time.micros(F.col("start").cast("timestamp_ntz")).alias("start_us"), "n", F.round("total", 6).alias("total"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
 s AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 7200000000 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 p AS (SELECT user_id, us, sum(b) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM s)
 SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM p GROUP BY user_id, k HAVING end_us <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM e)""")
def stream_passes(spark, sf_dir):
    """Passes of each key, at most two hours between observations, as soon as
    the watermark, an hour behind, has closed them."""
    out = _appended(drift.pass_stream(_landed(spark, sf_dir, []), "user_id", "ts", gap="2 hours", delay="1 hour"))
    us = lambda c: time.micros(F.col(c).cast("timestamp_ntz")).alias(f"{c}_us")
    return out.select("user_id", us("start"), us("end"), "n")
