"""Queries of review round 3 on tables that used to be too odd or too large."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from phenoscope.plans import registry

from .test_queries import plain

registry.load()


def both(spark, folder: str, name: str, table: str) -> tuple[list, list]:
    """What a query and its SQL give on one table of a folder."""
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return plain(registry.QUERIES[name](spark, folder).toPandas()), plain(con.sql(registry.ORACLE_SQL[name]).df())


def events(spark, folder: str, rows: list[tuple]) -> str:
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=m), u, e, v) for i, (m, u, e, v) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def test_scores_of_all_rows(spark, tmp_path):
    """Zeros, negative and missing values; 'none' has no valid positive value."""
    rows = [(0, u, "click", v) for u, v in enumerate((1.0, 2.0, 4.0, 0.0, -3.0, None, 8.0, 0.0, 5.0))]
    rows += [(0, 1, "one", 3.0), (0, 2, "one", 0.0), (0, 4, "none", 2.0), (0, 1, "none", 0.0), (0, 1, None, 2.0)]
    got, want = both(spark, events(spark, str(tmp_path), rows), "z01_log_zscore_scores_masked", "events")
    assert got == want and len(got) == 11


def test_no_pixels_are_broadcast(spark, tmp_path):
    from phenoscope.plans import detection

    rows = [(k, 1000.0 + k % 7) for k in range(1, 400)]
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    pixels = detection._lit_frames(spark, str(tmp_path))
    assert "Broadcast" not in pixels._jdf.queryExecution().executedPlan().toString()
    assert pixels.count() == 2 * 4 * 4096 and pixels.where("v is null").isEmpty()


def test_copies_of_scenes(spark, tmp_path, monkeypatch):
    """Keys 63,000 apart have equal boxes: pairs of boxes are made of pairs of
    places, and components never see them."""
    from phenoscope.operators import joins

    keys = [k + 63_000 * c for k in (1, 2, 7, 50, 1001, 7001, 14_001) for c in range(9)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("jn07_scene_overlap", "jn08_components"):
        got, want = both(spark, str(tmp_path), name, "customer")
        assert got == want and got
    seen, whole = [], joins.components
    monkeypatch.setattr(joins, "components", lambda e: seen.append(e.count()) or whole(e))
    registry.QUERIES["jn08_components"](spark, str(tmp_path))
    assert seen[0] < 30


def plain_dynamic(tt, yy, ok, freqs, window, min_span, least, k, ridge, estimator):
    """``harmonic._dynamic_fits`` one window at a time."""
    from phenoscope.operators import kernels

    out = []
    for i in range(len(tt)):
        use = ok & (tt < tt[i]) & (tt >= tt[i] - window)
        if tt[i] - tt[ok][0] < min_span or use.sum() < least or np.ptp(tt[use]) < min_span:
            continue
        wt, wy = tt[use] - tt[i], yy[use]
        z = wy - wy.mean()
        f = kernels.refined_pursuit(wt, z, freqs, k)[0] if estimator == "nomp" else kernels.distinct_peaks(freqs, kernels.spectrum(wt, z, freqs), k)
        a = kernels.harmonics(wt, list(1 / f), linear=False)
        g = np.linalg.inv(a.T @ a + ridge * np.eye(a.shape[1]))
        rest = wy - a @ (g @ a.T @ wy)
        x = kernels.harmonics(np.zeros(1), list(1 / f), linear=False)[0]
        out.append((i, x @ g @ a.T @ wy, max(1.4826 * np.median(np.abs(rest - np.median(rest))), 1e-6) * np.sqrt(1 + x @ g @ x), *f))
    return np.array(out)


@pytest.mark.parametrize("estimator,k", [("nomp", 1), ("nomp", 2), ("ndft", 1), ("ndft", 3)])
def test_windows_of_a_series_together(monkeypatch, estimator, k):
    """Refined frequencies and distinct peaks of all windows at once, without a
    search for each window."""
    from phenoscope.operators import harmonic, kernels

    rng, freqs = np.random.default_rng(k), np.linspace(0.2, 4, 40)
    tt = np.sort(np.round(rng.random(120) * 6.6, 2))
    yy, ok = 2 + np.cos(2 * np.pi * 1.37 * tt) + 0.5 * np.sin(2 * np.pi * 2.9 * tt) + 0.2 * rng.normal(size=120), rng.random(120) > 0.1
    want = plain_dynamic(tt, yy, ok, freqs, 2.0, 0.1, 8, k, 1e-5, estimator)
    monkeypatch.setattr(kernels, "refined_pursuit", None)
    monkeypatch.setattr(kernels, "distinct_peaks", None)
    got = harmonic._dynamic_fits(tt, yy, ok, freqs, 2.0, 0.1, 8, k, 1e-5, estimator)
    assert got["at"].tolist() == want[:, 0].astype(int).tolist()
    assert got["predicted"] == pytest.approx(want[:, 1], abs=1e-6) and got["bound"] == pytest.approx(want[:, 2], abs=1e-6)
    assert got["frequency"] == pytest.approx(want[:, 3:], abs=1e-6)


@pytest.mark.parametrize("penalty", ["l1", "log"])
def test_sparse_spectra_together(penalty):
    from phenoscope.operators import kernels

    rng, freqs = np.random.default_rng(9), np.linspace(0.2, 12, 60)
    times = [np.sort(rng.random(n) * 6.6) for n in (10, 90, 150)]
    values = [np.cos(2 * np.pi * 3.4 * t) + rng.normal(size=len(t)) for t in times]
    got = kernels.sparse_spectra(times, values, freqs, penalty, 300)
    for t, y, amp in zip(times, values, got, strict=True):
        # the plain steps, on the series itself
        a = np.concatenate([np.cos(2 * np.pi * t[:, None] * freqs), np.sin(2 * np.pi * t[:, None] * freqs)], 1)
        y = y - y.mean()
        weight, rate = 0.15 * np.abs(a.T @ y).max(), 1 / np.linalg.norm(a, 2) ** 2
        x, last, m = np.zeros(120), np.zeros(120), 1.0
        for step in range(300):
            eps = 1e-3 if step < 150 else 1e-4
            w = weight / (np.abs(x) + eps) * eps if penalty == "log" else weight
            new = last - rate * (a.T @ (a @ last - y))
            new = np.sign(new) * np.maximum(np.abs(new) - rate * w, 0)
            m2 = (1 + np.sqrt(1 + 4 * m * m)) / 2
            last, x, m = new + (m - 1) / m2 * (new - x), new, m2
        assert amp == pytest.approx(np.hypot(x[:60], x[60:]), abs=1e-8)


def test_one_pass_of_series(spark):
    """Series in several Arrow batches, null keys and null times; a sweep deals
    its rows once."""
    from phenoscope.operators import harmonic

    rows = [(None if p == 3 else p, None if i == 5 else float(i * 7 % n), float(i)) for p, n in enumerate((1, 40, 300, 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "p long, t double, v double")
    run = lambda pdf: pd.DataFrame({"first": [pdf["v"].iloc[0]], "last": [pdf["t"].iloc[-1]], "n": [len(pdf)], "sorted": [bool(pdf["t"].dropna().is_monotonic_increasing)]})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r.p: r for r in harmonic._per_series(df, ["p"], ["t"], run, "first double, last double, n long, sorted boolean").collect()}
        each = harmonic.sweep(df.withColumn("ok", df["t"].isNotNull()), ["p"], "t", "v", "ok", [{"periods": (1.0,)}, {"linear": False}])
        assert each._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and each.count() == 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {p: r.n for p, r in got.items()} == {0: 1, 1: 40, 2: 300, None: 6} and all(r.sorted for r in got.values())
    assert got[1].last is None and got[0].last == 0.0


def plain_greedy(left, right, reach):
    """All pairs of ``(key, id, time)`` in order."""
    pairs = sorted((lt, li, abs(lt - rt), rt, ri) for lk, li, lt in left for rk, ri, rt in right if lk == rk and abs(lt - rt) <= reach)
    taken, done, out = set(), set(), []
    for _, a, gap, _, b in pairs:
        if a not in done and b not in taken:
            done.add(a), taken.add(b), out.append((a, b, gap))
    return sorted(out)


@pytest.mark.parametrize("span", [40, 400, 20_000])
def test_greedy_pairs_without_pairs(spark, span):
    """Dense and sparse times, equal ones, stretches over several batches; the
    plan joins nothing."""
    from phenoscope.operators import joins

    rng = np.random.default_rng(span)
    sides = [[(int(k), 1000 * s + i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, span, n)))] for s, n in ((1, 150), (2, 130))]
    a, b = (spark.createDataFrame(rows, "k long, id long, t long") for rows in sides)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 23)
    try:
        got = joins.greedy_pairs(a, b, "t", "id", 9, ["k"])
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == plain_greedy(*sides, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_passes_of_many_quantiles(spark):
    """99 percentiles take a few passes over the table, not two for each."""
    from phenoscope.operators import stats

    x = np.random.default_rng(3).lognormal(size=30_000).round(3)
    df = spark.createDataFrame(pd.DataFrame({"v": x})).repartition(4)
    shares = [i / 100 for i in range(1, 100)]
    sc = spark.sparkContext
    sc.setJobGroup("quantiles", "")
    try:
        got = stats.exact_quantiles(df, "v", shares, keep=200)
        jobs = len(sc.statusTracker().getJobIdsForGroup("quantiles"))
    finally:
        sc.setJobGroup("other", "")
    assert got == pytest.approx(np.quantile(x, shares).tolist()) and jobs < 60
