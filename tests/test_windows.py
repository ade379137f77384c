"""Window statistics in bands against loops over every window; hulls."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoscope.operators import hulls, raster, windows, zscore

HEIGHT, WIDTH = 23, 11


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(5)
    values = rng.normal(1000, 3, (2, HEIGHT, WIDTH))
    values[0, 3:9, 2:8] = 7.25  # flat windows
    values[rng.random(values.shape) < 0.15] = np.nan
    return values


@pytest.fixture()
def rows(spark, frames, monkeypatch):
    monkeypatch.setattr(windows, "BAND_ROWS", 2)
    data = [(f, y, x, None if np.isnan(v) else float(v)) for (f, y, x), v in np.ndenumerate(frames)]
    return spark.createDataFrame(data, "f int, y int, x int, v double")


def origins(size, stride):
    return [(j, i) for j in range(0, HEIGHT - size + 1, stride) for i in range(0, WIDTH - size + 1, stride)]


def means(parts):
    return {k: float(np.mean(v)) for k, v in parts.items()}


def same(got, want, column):
    got = {(r.f, r.y, r.x): r[column] for r in got.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


@pytest.mark.parametrize("size, stride, guard", [(5, 1, None), (4, 3, None), (7, 2, 3), (5, 1, 1)])
@pytest.mark.parametrize("band_rows", [1, 3, 64])
def test_scores_in_windows(rows, frames, size, stride, guard, band_rows):
    parts = {}
    far = np.abs(np.arange(size) - size // 2)
    box = np.maximum(far[:, None], far) <= (guard or 0) // 2
    for f, image in enumerate(frames):
        for j, i in origins(size, stride):
            w = image[j : j + size, i : i + size]
            base = w if guard is None else w[~box]
            base = base[~np.isnan(base)]
            sd = base.std() if len(base) else 0.0
            if len(base) < (2 if guard is None else 5) or (guard is not None and sd <= 1e-6):
                continue
            for dy, dx in np.argwhere(~np.isnan(w) & (box if guard is not None else True)):
                z = 0.0 if sd <= 1e-12 else (w[dy, dx] - base.mean()) / sd
                parts.setdefault((f, j + dy, i + dx), []).append(z)
    if guard is None:
        got = zscore.local_zscore(rows, "v", size, stride, HEIGHT, WIDTH, ["f"], band_rows)
    else:
        got = zscore.annular_zscore(rows, "v", size, guard, stride, HEIGHT, WIDTH, ["f"], band_rows)
    same(got, means(parts), "z")


@pytest.mark.parametrize("size, stride", [(3, 1), (4, 2)])
def test_distances_to_the_mean_spectrum(rows, frames, size, stride):
    parts = {}
    for f, image in enumerate(frames):
        cube = np.stack([image, np.sqrt(image), image % 5], -1)
        for j, i in origins(size, stride):
            w = cube[j : j + size, i : i + size]
            ok = ~np.isnan(w[..., 0])
            if ok.any():
                d = np.sqrt(((w[ok] - w[ok].mean(0)) ** 2).sum(1)).mean()
                for dy, dx in np.argwhere(ok):
                    parts.setdefault((f, j + dy, i + dx), []).append(d)
    spectra = rows.select("f", "y", "x", F.when(F.col("v").isNotNull(), F.array("v", F.sqrt("v"), F.col("v") % 5)).alias("s"))
    same(raster.mean_spectral_distance(spectra, "s", size, stride, HEIGHT, WIDTH, ["f"], 3), means(parts), "msd")


def test_clear_windows(rows, frames):
    got = {(r.f, r.wy, r.wx): (r["clear"], r.variance) for r in windows.clear_windows(rows, ["f"], "v", F.col("v") > 999, 4, 2, HEIGHT, WIDTH, 2).collect()}
    assert len(got) == 2 * len(origins(4, 2))
    for f, image in enumerate(frames):
        for j, i in origins(4, 2):
            w = image[j : j + 4, i : i + 4]
            w = w[w > 999]
            n, variance = got[f, j, i]
            assert n == len(w) and abs(variance - (w.var() if len(w) else 0)) < 1e-9
    best = raster.best_window(rows.where("f = 1"), "v", F.col("v") > 999, 4, 2, HEIGHT, WIDTH, 0.1).first()
    assert best.share == max(got[1, j, i][0] for j, i in origins(4, 2)) / 16


def test_frames_smaller_than_a_window(rows):
    assert zscore.local_zscore(rows.where("y < 3"), "v", 5, 1, 3, WIDTH, ["f"]).count() == 0
    assert zscore.local_zscore(rows.where("false"), "v", 5, 1, HEIGHT, WIDTH, ["f"]).count() == 0


def corners_by_hand(points):
    """A corner is no point of any segment or triangle of other points: for each
    of them all others lie within less than half a turn."""
    out = set()
    points = sorted(set(points))
    if len(points) == 1:
        return set(points)
    for p in points:
        rest = np.array([q for q in points if q != p], float) - p
        angle = np.sort(np.arctan2(rest[:, 1], rest[:, 0]))
        gaps = np.diff(np.r_[angle, angle[0] + 2 * np.pi])
        if gaps.max() > np.pi + 1e-9:
            out.add(p)
    return out


@pytest.mark.parametrize("fan_in", [2, 16])
def test_hulls_of_dealt_points(spark, monkeypatch, fan_in):
    monkeypatch.setattr(hulls, "FAN_IN", fan_in)
    rng = np.random.default_rng(2)
    sets = {
        "cloud": rng.normal(size=(300, 2)).round(2),
        "lattice": rng.integers(0, 6, (300, 2)).astype(float),
        "line": np.stack([np.arange(40), 2 * np.arange(40)], 1).astype(float),
        "point": np.ones((5, 2)),
        "pair": np.array([[1.0, 2.0], [0.0, 3.0]]),
        None: rng.integers(0, 30, (200, 2)).astype(float),
    }
    data, n = [], 0
    for key, points in sets.items():
        for x, y in points.tolist():
            data.append((key, n, x, y))
            n += 1
    data += [("cloud", -1, None, 1.0), ("cloud", -2, float("nan"), 0.0), ("cloud", -3, 0.0, float("inf")), ("none", 1, None, None)]
    df = spark.createDataFrame(data, "k string, id long, x double, y double").repartition(9)
    got = hulls.convex_hulls(df, ["k"], "id", "x", "y").collect()
    assert {r.k for r in got} == set(sets)
    for key, points in sets.items():
        mine = sorted((r.corner, r.x, r.y, r.id) for r in got if r.k == key)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert {m[1:3] for m in mine} == corners_by_hand([tuple(p) for p in points.tolist()])
        assert mine[0][1:3] == min(m[1:3] for m in mine)
        for _, x, y, id in mine:
            assert id == min(d[1] for d in data if d[0] == key and d[2:] == (x, y))
        area = sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(mine, mine[1:] + mine[:1]))
        assert len(mine) < 3 or area > 0  # against the clock
    assert len(hulls.convex_hulls(df.where("k = 'lattice'"), [], "id", "x", "y").collect()) == len([r for r in got if r.k == "lattice"])


def test_points_inside_are_left_out_before_the_search():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 20_000))
    may = hulls._outer(x, y)
    assert len(may) < 2_000
    assert set(hulls.hull_places(x, y)) == set(may[hulls.hull_places(x[may], y[may])])
