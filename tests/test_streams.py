"""Streams over landing folders: order, late rows, restarts."""

from __future__ import annotations

import datetime as dt

import pytest

from phenoscope.operators.detect import Drift
from phenoscope.streaming import files

SCHEMA = "k long, ts timestamp, id long, score double"


def rows(n, seed, start=0):
    import random

    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    return [(rng.randrange(4), base + dt.timedelta(hours=start + i), 1000 * seed + i, None if rng.random() < 0.1 else rng.gauss(1, 0.1) + (rng.random() < 0.1)) for i in range(n)]


def statuses(data):
    state, out = {}, {}
    for k, _, i, s in sorted(data, key=lambda r: (r[1], r[2])):
        state[k], out[(k, i)] = Drift().step(state.get(k, Drift.START), s or 0.0, s is not None)
    return out


def test_drops_are_in_order_of_time(spark, tmp_path):
    data = rows(90, 1)
    df = spark.createDataFrame([*data[::-1], (9, None, 5, 1.0)], SCHEMA)
    files.land(df, f"{tmp_path}/in", "ts", 3)
    seen = files.append_available(files.stream_of(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(map(str, seen.collect())) == sorted(map(str, df.collect()))
    spans = [spark.read.parquet(f).agg({"ts": "min"}).first()[0] for f in sorted(spark.read.parquet(f"{tmp_path}/in").inputFiles())]
    assert len(spans) == 3


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """A second run takes only what is new and goes on from the states; a third
    finds nothing and appends nothing."""
    first, second = rows(120, 2), rows(60, 3, start=120)
    source, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"

    def work(new):
        if new:
            spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = files.stream_of(spark, source, spark.createDataFrame([], SCHEMA).schema)
        got = files.append_available(files.drift_states(stream, "k", "ts", "id", "score"), out, cp).collect()
        assert len(got) == len({(r.k, r.id) for r in got})
        return {(r.k, r.id): r.status for r in got}

    assert work(first) == statuses(first)
    assert work(second) == statuses(first + second)
    assert work(None) == statuses(first + second)


def test_late_rows_leave_windows_as_they_are(spark, tmp_path):
    source, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)

    def work(new):
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = files.stream_of(spark, source, spark.createDataFrame([], SCHEMA).schema)
        got = files.append_available(files.hourly(stream, "ts", "score", "2 hours", keys=["k"]), out, cp)
        return sorted((r.k, r.start.day * 24 + r.start.hour - 24, r.n, r.total) for r in got.collect())

    assert work([(1, at(0.5), 1, 1.0), (1, at(1.2), 2, 2.0), (1, at(5.5), 3, 4.0)]) == [(1, 0, 1, 1.0), (1, 1, 1, 2.0)]
    # an hour that is closed gets nothing more; an open one does, though it is out of order
    assert work([(1, at(0.7), 4, 8.0), (1, at(5.1), 5, 16.0), (1, at(9.0), 6, 32.0)]) == [(1, 0, 1, 1.0), (1, 1, 1, 2.0), (1, 5, 2, 20.0)]


def test_rows_seen_again_are_left_out(spark, tmp_path):
    data = rows(30, 4)
    for k in range(2):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = files.stream_of(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    out = files.append_available(files.first_sight(stream, ["id"], "ts", "3 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.id for r in out.collect()) == sorted(r[2] for r in data)


@pytest.mark.parametrize("name", ["stream_drift_statuses", "stream_hourly_sums", "stream_passes"])
def test_streams_are_registered_with_their_batch_forms(name):
    from phenoscope.plans import registry

    registry.load()
    assert name in registry.QUERIES and name in registry.ORACLE_SQL
