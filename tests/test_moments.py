"""Windows by running sums against one fit a window."""

from __future__ import annotations

import time

import numpy as np
import pytest

from phenoscope.operators import harmonic, kernels, moments


def observations(n=160, seed=1):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(2015, 2023, n))
    t[40] = t[41]
    y = 1 + 0.4 * np.cos(2 * np.pi * t) + 0.2 * np.sin(2 * np.pi * 2.3 * t) + rng.normal(0, 0.05, n) + (t > 2021.5) * 1.5
    return t, y, rng.random(n) < 0.85


def plain_rows(tt, yy, ok, window, freqs, k=2, least=8, min_span=0.1, ridge=1e-5, factor=2.0):
    out, streak = [], 0
    for i in range(len(tt)):
        use = ok & (tt < tt[i]) & (tt >= tt[i] - window)
        if ok.any() and tt[i] - tt[ok][0] >= min_span and use.sum() >= least and np.ptp(tt[use]) >= min_span:
            wt, wy = tt[use] - tt[i], yy[use]
            f = kernels.matching_pursuit(wt, wy - wy.mean(), freqs, k, ridge)[0]
            a = kernels.harmonics(wt, list(1 / f), linear=False)
            g = np.linalg.inv(a.T @ a + ridge * np.eye(a.shape[1]))
            coef = g @ a.T @ wy
            rest = wy - a @ coef
            x = kernels.harmonics(np.zeros(1), list(1 / f), linear=False)[0]
            s = max(1.4826 * np.median(np.abs(rest - np.median(rest))), 1e-6) * np.sqrt(1 + x @ g @ x)
            odd = bool(ok[i] and abs(yy[i] - x @ coef) > factor * s)
            streak = streak + 1 if odd else 0
            out.append((x @ coef, s, f[0], odd, streak))
        else:
            streak = 0 if not ok[i] else streak
            out.append((None, None, None, False, streak))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_rows_equal_one_fit_a_window(spark, monkeypatch, block):
    monkeypatch.setattr(moments, "BLOCK", block)
    t, y, ok = observations()
    freqs = np.linspace(0.2, 4.0, 100)
    want = plain_rows(t, y, ok, 2.0, freqs)
    got = harmonic._dynamic_fits(t, y, ok, freqs, 2.0, 0.1, 8, 2, 1e-5)
    at = [i for i, w in enumerate(want) if w[0] is not None]
    assert got["at"].tolist() == at
    assert got["predicted"] == pytest.approx([want[i][0] for i in at], rel=1e-6, abs=1e-7)
    assert got["bound"] == pytest.approx([want[i][1] for i in at], rel=1e-6)
    assert got["frequency"][:, 0].tolist() == [want[i][2] for i in at]


def test_rows_in_spark(spark):
    t, y, ok = observations()
    data = [("a", float(a), float(b), bool(c)) for a, b, c in zip(t, y, ok, strict=True)] + [("b", 2020.0, None, True), ("b", 2020.5, 1.0, None)]
    df = spark.createDataFrame(data, "k string, t double, v double, ok boolean").repartition(3)
    rows = harmonic.dynamic_rows(df, ["k"], "t", "v", "ok", window=2.0).toPandas().sort_values(["k", "t", "v"])
    a = rows[rows["k"] == "a"]
    order = np.lexsort((y, t))
    want = plain_rows(t, y, ok, 2.0, np.linspace(0.2, 4.0, 100))
    want = [want[i] for i in order]
    assert a["anomaly"].tolist() == [w[3] for w in want]
    assert a["predicted"].astype(float).tolist() == pytest.approx([np.nan if w[0] is None else w[0] for w in want], rel=1e-6, abs=1e-7, nan_ok=True)
    assert any(w[4] >= 4 for w in want) and a["change"].tolist() == [w[4] >= 4 for w in want] and a["streak"].tolist() == [w[4] for w in want]
    assert rows[rows["k"] == "b"]["bound"].isna().all()
    one = harmonic.dynamic(df.where("k = 'a'"), ["k"], "t", "v", "ok", window=2.0).collect()[0]
    scored = [(w, i) for w, i in zip(want, order, strict=True) if w[0] is not None]
    assert one.scored == sum(ok[i] for _, i in scored) and one.anomalies == sum(w[3] for w in want)
    assert one.change_at == next(t[i] for w, i in scored if w[4] == 4)


def test_features_equal_one_fit_a_window(spark):
    t, y, ok = observations(90, 2)
    df = spark.createDataFrame([("a", float(a), float(b), bool(c)) for a, b, c in zip(t, y, ok, strict=True)], "k string, t double, v double, ok boolean")
    rows = harmonic.spectral_features(df, ["k"], "t", "v", "ok", windows=(0.5, 2.0)).toPandas()
    freqs = np.linspace(0.2, 4.0, 60)
    for i, (features, good) in enumerate(zip(rows["features"], rows["ok"], strict=True)):
        want, fine = [], bool(ok[i])
        for w in (0.5, 2.0):
            use = ok & (t <= t[i]) & (t >= t[i] - w)
            if use.sum() < 6:
                want += [0.0] * 6
                fine = False
                continue
            f, coef = kernels.matching_pursuit(t[use] - t[i], y[use], freqs, 2)
            rest = y[use] - kernels.harmonics(t[use] - t[i], list(1 / f), linear=False) @ coef
            want += [*coef, rest.std()]
        assert good == fine and list(features) == pytest.approx(want, rel=1e-4, abs=1e-4), i


def test_running_sums_take_a_third_of_the_time():
    t, y, ok = observations(400, 3)
    freqs = np.linspace(0.2, 4.0, 100)
    began = time.perf_counter()
    plain_rows(t, y, ok, 2.0, freqs)
    single = time.perf_counter() - began
    began = time.perf_counter()
    harmonic._dynamic_fits(t, y, ok, freqs, 2.0, 0.1, 8, 2, 1e-5)
    assert time.perf_counter() - began < single / 3
