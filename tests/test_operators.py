"""Spark operators against NumPy and plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoscope.functions import qa, spectral
from phenoscope.operators import complexity, detect, harmonic, joins, kernels, raster, series, zscore
from phenoscope.sources import metadata, readers
from phenoscope.streaming import drift


def frame(spark, cube, hole=None):
    h, w, _ = cube.shape
    rows = [(0, y, x, None if hole and (y, x) in hole else cube[y, x].tolist()) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "frame long, y int, x int, s array<double>")


def plain_sliding(cube, size, stride, count, ok):
    h, w, _ = cube.shape
    total, n = np.zeros((h, w)), np.zeros((h, w))
    for y in range(0, h - size + 1, stride):
        for x in range(0, w - size + 1, stride):
            if ok[y : y + size, x : x + size].all():
                v = kernels.complexity(cube[y : y + size, x : x + size].reshape(1, size * size, -1), count)[0]
                total[y : y + size, x : x + size] += v
                n[y : y + size, x : x + size] += 1
    return {(y, x): total[y, x] / n[y, x] for y in range(h) for x in range(w) if n[y, x]}


@pytest.mark.parametrize("size,stride,band", [(3, 1, 4), (4, 2, 2), (3, 1, 100), (5, 3, 1)])
def test_sliding_complexity(spark, size, stride, band):
    cube = np.random.default_rng(7).random((17, 13, 6))
    hole = {(4, 4), (9, 11)}
    ok = np.ones((17, 13), bool)
    for p in hole:
        ok[p] = False
    got = complexity.sliding_complexity(frame(spark, cube, hole), ["frame"], "s", size, stride, 5, 17, 13, band_rows=band).collect()
    want = plain_sliding(cube, size, stride, 5, ok)
    assert {(r.y, r.x) for r in got} == set(want)
    assert all(r.complexity == pytest.approx(want[r.y, r.x], rel=1e-9) for r in got)


def test_large_windows_do_not_wrap(spark):
    cube = np.random.default_rng(8).random((14, 14, 4))
    got = complexity.sliding_complexity(frame(spark, cube), ["frame"], "s", 12, 1, 4, 14, 14).collect()
    want = plain_sliding(cube, 12, 1, 4, np.ones((14, 14), bool))
    assert all(r.complexity == pytest.approx(want[r.y, r.x], rel=1e-9) for r in got) and len(got) == 196


def test_tiles(spark):
    cube = np.random.default_rng(9).random((8, 9, 5))
    got = {(r.ty, r.tx): r.value for r in complexity.tile_complexity(frame(spark, cube, {(0, 0)}), ["frame"], "s", 4, 5).collect()}
    assert (0, 0) not in got and (0, 1) in got
    want = kernels.complexity(cube[:4, 4:8].reshape(1, 16, 5), 5)[0]
    assert got[0, 1] == pytest.approx(want) and got[0, 2] is None


def test_box_mean_equals_loop(spark):
    v = np.random.default_rng(1).random((9, 7))
    df = spark.createDataFrame([(y, x, float(v[y, x])) for y in range(9) for x in range(7)], "y int, x int, v double")
    got = {(r.y, r.x): r["mean"] for r in raster.box_mean(df, "v", 3, 9, 7).collect()}
    total, n = np.zeros((9, 7)), np.zeros((9, 7))
    for y in range(7):
        for x in range(5):
            total[y : y + 3, x : x + 3] += v[y : y + 3, x : x + 3].mean()
            n[y : y + 3, x : x + 3] += 1
    assert all(got[y, x] == pytest.approx(total[y, x] / n[y, x]) for y in range(9) for x in range(7))


def test_zscore_rules(spark):
    data = [("a", 1.0, True), ("a", 2.0, True), ("a", 4.0, True), ("a", -1.0, True), ("a", 8.0, False), ("b", 3.0, True), ("c", 2.0, True), ("c", 2.0, True), ("d", None, True)]
    df = spark.createDataFrame(data, "k string, v double, ok boolean")
    rows = zscore.log_zscore(df, "v", ["k"], valid=F.col("ok")).collect()
    z = [r.z for r in rows if r.k == "a" and r.z is not None]
    assert len(z) == 3 and sum(z) == pytest.approx(0) and np.std(z, ddof=1) == pytest.approx(1)
    assert all(r.z is None for r in rows if r.k != "a")
    both = [r.z for r in zscore.log_zscore(df, "v", ["k"], valid=F.col("ok"), score="positive").collect() if r.k == "a" and r.z is not None]
    assert len(both) == 4
    with pytest.raises(Exception, match="constant group"):
        zscore.log_zscore(df.where("k = 'c'"), "v", ["k"], strict=True).collect()


def test_streak_modes(spark):
    flags = [(1, True, True), (2, True, False), (3, True, True), (4, False, True), (5, True, True), (6, False, False), (7, True, True)]
    df = spark.createDataFrame([("k", *f) for f in flags], "k string, t int, hit boolean, ok boolean")
    run = lambda m: [r.streak for r in series.streaks(df, ["k"], ["t"], F.col("hit"), F.col("ok"), m).orderBy("t").collect()]
    assert run("reset") == [1, 0, 1, 0, 1, 0, 1]
    assert run("skip") == [1, 0, 2, 0, 1, 0, 2]
    assert run("hold") == [1, 1, 2, 0, 1, 1, 2]


def test_session_boundary(spark):
    us = [0, 60_000_000, 121_000_000]
    df = spark.createDataFrame([("k", t) for t in us], "k string, us long")
    assert [r.session for r in series.sessions(df, ["k"], "us", 60_000_000).orderBy("us").collect()] == [0, 0, 1]


def test_cusum_equals_recursion(spark):
    d = np.random.default_rng(2).normal(1, 1, 200)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(d)], "k string, t int, d double")
    got = [r.cusum for r in detect.cusum(df, ["k"], ["t"], "d").orderBy("t").collect()]
    s, want = 0.0, []
    for v in d:
        s = max(0.0, s + v - np.median(d) - 0.5)
        want.append(s)
    assert got == pytest.approx(want, abs=1e-9)


def test_drift_contract():
    det, state = detect.Drift(warm=3, run=2), detect.Drift.START
    seen = []
    for s in (1.0, 1.1, 0.9, 1.0, 50.0, 60.0, 1.0):
        state, status = det.step(state, s, True)
        seen.append(status)
    assert seen[:3] == [3, 3, 3] and seen[4] == 0 and seen[5] == 2
    assert seen[6] == 3  # warm-up again after the reset
    assert det.step((0.0, 1.0, 1, 30), 99.0, False) == ((0.0, 1.0, 1, 30), 0)


def test_drift_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(k, f"2024-01-01 00:{i % 60:02d}:{i // 60:02d}", i * 10 + k, float(abs(rng.normal(1, 0.1)) + (5 if i > 60 else 0)) if i % 9 else None) for k in range(3) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, ts string, id long, score double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = detect.drift_statuses(df.withColumn("ok", F.col("score").isNotNull()), ["k"], ["ts", "id"], "score", "ok")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = drift.drift_stream(stream, "k", "ts", "id", "score").writeStream.format("memory").queryName("drift_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.id): r.status for r in spark.table("drift_out").collect()} == {(r.k, r.id): r.status for r in batch.collect()}


def test_harmonic_change(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.random(300) * 10)
    y = 0.3 + 0.1 * np.cos(2 * np.pi * t) + 0.005 * rng.normal(size=300)
    y[t > 7] += 0.5
    df = spark.createDataFrame([(1, float(a), float(b), True) for a, b in zip(t, y)], "k long, t double, v double, ok boolean")
    for got in (
        harmonic.train_and_scan(df, ["k"], "t", "v", "ok", 5.0).first(),
        harmonic.sliding_baseline(df, ["k"], "t", "v", "ok", factor=5.0).first(),
        harmonic.harmonized(df, ["k"], "t", "v", "ok", periods=(1.0,), factor=3.0).first(),
    ):
        assert got.change_at == pytest.approx(7, abs=0.1)
    assert harmonic.dynamic(df, ["k"], "t", "v", "ok", bins=30, factor=5.0).first().change_at == pytest.approx(7, abs=0.4)


def test_greedy_matches(spark):
    a = spark.createDataFrame([("k", 1, 0), ("k", 2, 4)], "k string, id long, t long")
    b = spark.createDataFrame([("k", 11, 3), ("k", 12, 30)], "k string, id long, t long")
    got = joins.greedy_pairs(a, b, "t", "id", 5, ["k"]).collect()
    assert [(r.left_id, r.right_id, r.gap) for r in got] == [(1, 11, 3)]
    near = joins.nearest(a, b, "t", "id", 5, ["k"]).collect()
    assert sorted((r.l_id, r.r_id) for r in near) == [(1, 11), (2, 11)]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 5)], "a long, b long")
    assert {r.id: r.component for r in joins.components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 5}


def test_masks_and_indices(spark):
    df = spark.createDataFrame([(0, 10.0, 0.2, 0.6), (6, 10.0, 0.0, 0.0), (192, 10.0, -0.1, 0.05), (0, None, 0.5, None)], "f int, z double, r double, n double")
    got = df.select(qa.hls_invalid(F.col("f"), F.col("z"), 6, "medium", 25.0).alias("m"), spectral.ndvi(F.col("r"), F.col("n")).alias("i")).collect()
    assert [r.m for r in got] == [False, True, True, True]
    assert [r.i for r in got] == [pytest.approx(0.5), None, -1.0, None]


def test_grid_text_round_trip(spark):
    text = metadata.grid_text("g", 10, 20, (300.5, 4e6), (600.0, 3e6), -12)
    g = spark.createDataFrame([(text,)], "t string").select(metadata.grid_parameters(F.col("t")).alias("g")).first().g
    assert (g.ul_x, g.ul_y, g.cols, g.rows, g.zone, g.epsg) == (300.5, 4e6, 10, 20, -12, 32712)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station,x\nabout\n" + "day,aod,w\n" + "1,0.5,2\n2,-999,3\n")
    assert [tuple(r) for r in readers.delimited_after_header(spark, str(tmp_path / "a.csv"), 2, ["day", "aod", "w"], fill=-999.0).collect()] == [(1.0, 0.5, 2.0)]
    (tmp_path / "s.txt").write_text("# comment\n400 1.5\n  410   1.6\nx y\n")
    assert [tuple(r) for r in readers.irradiance_table(spark, str(tmp_path / "s.txt")).orderBy("nm").collect()] == [(400.0, 15.0), (410.0, 16.0)]
    (tmp_path / "r.csv").write_text("1,2\n3,\n")
    assert sorted((r.y, r.x, r.value) for r in readers.raster_csv(spark, str(tmp_path / "r.csv")).where("value is not null").collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id % 10 as user_id", "id as value", "id as other").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).where("user_id = 7").select("user_id", "value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan and "other" not in plan


def test_prediction_rows_are_those_of_single_fits(spark):
    import numpy as np

    from phenoscope.operators import harmonic, kernels

    rng = np.random.default_rng(4)
    data = []
    for key, n in ((1, 120), (2, 14), (3, 0), (4, 40)):
        t = np.sort(rng.uniform(2000, 2009, n))
        y = np.sin(2 * np.pi * t) + 0.1 * rng.normal(size=n)
        y[n // 2 : n // 2 + 4] += 4
        data += [(key, float(a), float(b), bool(rng.random() > 0.1)) for a, b in zip(t, y)]
    df = spark.createDataFrame(data, "k int, t double, v double, ok boolean")
    got = {(r.k, r.t): r for r in harmonic.harmonized_rows(df, ["k"], "t", "v", "ok", run=2).collect()}
    assert len(got) == len(data)
    fitted = 0
    for key in (1, 2, 4):
        rows = sorted(d for d in data if d[0] == key)
        use = [d for d in rows if d[3]]
        tt, yy = np.array([d[1] for d in use]), np.array([d[2] for d in use])
        streak = 0
        for i, d in enumerate(use):
            lo = int(np.searchsorted(tt, tt[i] - 3))
            lo = lo if i - lo >= 12 else i - 12
            r = got[key, d[1]]
            if tt[i] - tt[0] < 3 or lo < 0 or (i - lo == 12 and tt[i] - tt[lo] > 5):
                assert r.predicted is None and r.rmse is None and not r.anomaly
                continue
            a = kernels.harmonics(tt[lo : i + 1] - tt[i], list(harmonic.PERIODS))
            coef, rmse = kernels.least_squares(a[:-1], yy[lo:i])
            assert r.predicted == pytest.approx(a[-1] @ coef, abs=1e-6) and r.rmse == pytest.approx(max(rmse, 1e-5), rel=1e-5)
            streak = streak + 1 if abs(yy[i] - a[-1] @ coef) > 3 * max(rmse, 1e-5) else 0
            assert (r.streak, r.anomaly, r.change) == (streak, streak > 0, streak >= 2)
            fitted += 1
        assert all(got[d[0], d[1]].predicted is None for d in rows if not d[3])
    assert fitted > 60


def test_drift_of_many_series_is_that_of_each(spark):
    import numpy as np

    from phenoscope.operators.detect import Drift, drift_statuses

    rng, detector = np.random.default_rng(8), Drift(warm=5)
    data = [(k, i, float(rng.exponential() * (5 if i > 30 else 1)), bool(rng.random() > 0.15)) for k in range(40) for i in range(int(rng.integers(1, 60)))]
    data += [(None, i, 1.0, True) for i in range(3)] + [(50, 0, None, None)]
    df = spark.createDataFrame(data, "k int, i int, s double, ok boolean").repartition(3)
    got = {(r.k, r.i): r.status for r in drift_statuses(df, ["k"], ["i"], "s", "ok", detector).collect()}
    for key in {d[0] for d in data}:
        state = Drift.START
        for _, i, s, v in sorted((d for d in data if d[0] == key), key=lambda d: d[1]):
            state, status = detector.step(state, s if v else 0.0, bool(v))
            assert got[key, i] == status
    assert drift_statuses(df.limit(0), ["k"], ["i"], "s", "ok").collect() == []


@pytest.mark.parametrize("kind", ["spread", "lumps", "one"])
def test_exact_quantiles(spark, kind):
    import numpy as np

    from phenoscope.operators.stats import exact_quantiles

    rng = np.random.default_rng(2)
    x = {"spread": rng.lognormal(0, 6, 3000), "lumps": rng.integers(0, 5, 3000) * 1.0, "one": np.full(10, 3.5)}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    shares = [0.0, 0.013, 0.5, 0.98, 1.0]
    assert exact_quantiles(df, "v", shares, bins=16, keep=50) == pytest.approx(np.quantile(x, shares).tolist())
    assert exact_quantiles(df.limit(0), "v", shares) == [None] * 5


@pytest.mark.parametrize("odd", [[math.inf], [math.nan], [-math.inf, -math.inf, math.inf, math.nan, math.nan]])
def test_exact_quantiles_of_odd_values(spark, odd):
    """Infinities and NaN beyond ``keep`` values end, in the order of percentile."""
    from pyspark.sql import functions as F

    from phenoscope.operators.stats import exact_quantiles

    x = [*np.random.default_rng(3).normal(size=500).tolist(), *odd]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = df.agg(F.percentile("v", shares)).first()[0]
    assert exact_quantiles(df, "v", shares, bins=16, keep=50) == pytest.approx(want, nan_ok=True)


def test_exact_quantiles_of_any_spread_end_soon(spark, monkeypatch):
    """Values over 600 orders of magnitude, where bins of equal width hardly narrow."""
    from phenoscope.operators import stats

    x = np.concatenate((10.0 ** np.linspace(-300, 300, 3001), [-1.7e308, 1.7e308], np.full(500, 2.0)))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    rounds, plain = [], stats._splits
    monkeypatch.setattr(stats, "_splits", lambda *a: rounds.append(1) or plain(*a))
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert stats.exact_quantiles(df, "v", shares, bins=16, keep=50) == pytest.approx(np.quantile(x, shares).tolist())
    assert len(rounds) < 30


def test_drift_of_one_long_series_among_many(spark):
    """A key of 100,000 rows beside 10,000 keys of one: rows set the memory."""
    import resource

    from phenoscope.operators import detect

    rng = np.random.default_rng(4)
    score = rng.normal(1.0, 0.1, 110_000) + (rng.random(110_000) < 0.02)
    valid = rng.random(110_000) < 0.95
    first = np.concatenate(([0], np.arange(100_000, 110_000)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got, last = detect.Drift().steps(score, valid, first)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB
    state, want = detect.Drift.START, []
    for x, ok in zip(score[:100_000].tolist(), valid[:100_000].tolist(), strict=True):
        state, status = detect.Drift().step(state, x, ok)
        want.append(status)
    assert got[:100_000].tolist() == want and len(got) == 110_000
    assert last == detect.Drift().step(detect.Drift.START, float(score[-1]), bool(valid[-1]))[0]


def test_drift_goes_on_over_batches(spark):
    from phenoscope.operators import detect

    rng = np.random.default_rng(5)
    rows = [(int(k), i, float(rng.normal(1, 0.1) + (rng.random() < 0.1)), bool(rng.random() < 0.9)) for k, n in enumerate([400, 1, 150, 3, 90]) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, s double, ok boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.k, r.i): r.status for r in detect.drift_statuses(df, ["k"], ["i"], "s", "ok", step_rows=100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, want = {}, {}
    for k, i, x, ok in rows:
        state[k], want[(k, i)] = detect.Drift().step(state.get(k, detect.Drift.START), x, ok)
    assert got == want


def test_scores_of_null_keys(spark):
    import math

    from phenoscope.operators.zscore import log_zscore

    df = spark.createDataFrame([(None, 1.0), (None, math.e), ("a", 2.0), ("a", None), ("a", -1.0)], "k string, v double")
    got = log_zscore(df, "v", ["k"]).collect()
    assert len(got) == 5
    assert sorted(r.z for r in got if r.z is not None) == pytest.approx([-(0.5**0.5), 0.5**0.5])
