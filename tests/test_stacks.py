"""Stacks, resampling and distributed extreme spectra against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoscope.operators import complexity, extremes, kernels, stacks


@pytest.fixture(params=[0, extremes.WHOLE_ROWS])
def whole(request, monkeypatch):
    """All frames by steps, then all of them whole in a task."""
    monkeypatch.setattr(extremes, "WHOLE_ROWS", request.param)


def cloud(spark, x, extra=()):
    rows = [(1, i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "k long, id long, s array<double>")


@pytest.mark.parametrize("unit", [False, True])
def test_extreme_spectra(spark, whole, unit):
    x = np.random.default_rng(3).random((300, 9))
    x[50] = x[10]  # a repeated spectrum
    extra = [(1, 900, None), (1, 901, [float("nan")] * 9), (None, 5, [9.0] * 9), (2, 7, [1.0] * 9)]
    got = extremes.extreme_spectra(cloud(spark, x, extra), ["k"], "id", "s", 7, unit).orderBy("rank").collect()
    assert [r.k for r in got] == [1] * 7
    assert [r.id for r in got] == kernels.max_distance(x[None], 7, unit=unit)[0].tolist()


@pytest.mark.parametrize("origin", ["zero", "datasetMean", "endmemberMean", "closestToMean", "minEndmember"])
def test_volume_curves(spark, whole, origin):
    x = np.random.default_rng(5).random((80, 12))
    got = extremes.volume_curves(cloud(spark, x), ["k"], "id", "s", 6, origin).orderBy("m").collect()
    ends = x[kernels.max_distance(x[None], 6)[0]][None]
    want = kernels.volumes(ends, origin, x.mean(0)[None])[0]
    want = want / 12 ** (np.arange(1, len(want) + 1) / 2)
    assert [r.volume for r in got] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-15)


def test_projected_volumes(spark, whole):
    x = np.random.default_rng(6).random((60, 8))
    got = [r.volume for r in extremes.projected_volumes(cloud(spark, x), ["k"], "id", "s", 5).orderBy("m").collect()]
    ends = x[kernels.max_distance(x[None], 5)[0]]
    want = [0.0] + [np.sqrt(np.linalg.det(ends[:m] @ ends[:m].T)) for m in range(2, 6)]
    assert got == pytest.approx(want, rel=1e-7)
    line = np.outer(np.arange(1, 9), np.ones(4))  # all on one line: nothing beyond the first direction
    got = [r.volume for r in extremes.projected_volumes(cloud(spark, line), ["k"], "id", "s", 5).orderBy("m").collect()]
    assert got == pytest.approx([0.0] * 5, abs=1e-5)


def test_farthest_from_hull(spark, whole):
    x = np.random.default_rng(8).random((120, 9))
    got = extremes.extreme_spectra(cloud(spark, x), ["k"], "id", "s", 7, hull=True).orderBy("rank").collect()
    assert [r.id for r in got] == kernels.farthest_from_hull(x, 7).tolist()
    line = np.outer(np.arange(1, 9), np.ones(4))  # two ends span it, nothing is left
    got = extremes.extreme_spectra(cloud(spark, line), ["k"], "id", "s", 4, hull=True).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 0]


@pytest.mark.parametrize("low, high", [(-0.5, 0.9), (-0.5, 3.0), (0.1, 1.7), (0.1, 0.9)])
def test_clip_legacy(spark, low, high):
    x = np.random.default_rng(9).uniform(low, high, (40, 5))
    got = extremes.clip_legacy(cloud(spark, x, [(1, 99, None)]), ["k"], "s").orderBy("id").collect()
    assert [r.s for r in got] == kernels.clip_legacy(x).tolist()


def test_functional_complexity(spark):
    x = np.random.default_rng(10).random((90, 31))
    waves = np.linspace(400, 2500, 31)
    w = np.gradient(waves)
    want = kernels.functional_complexity(x, waves, w / w.sum())
    rows = cloud(spark, x, [(1, 99, None), (1, 98, [float("nan")] * 31), (1, 97, [1.0]), (2, 96, [0.5] * 31)])
    got = {r.k: r.value for r in complexity.functional_complexity(rows, ["k"], "s").collect()}
    assert got[1] == pytest.approx(want, rel=1e-9)
    assert got[2] == 0.0
    assert complexity.functional_complexity(rows.where("false"), ["k"], "s").count() == 0


def test_extreme_sets_of_both_kinds(spark):
    rng = np.random.default_rng(12)
    x, y = rng.random((50, 6)), rng.random((30, 6))
    rows = cloud(spark, x, [(2, i, v.tolist()) for i, v in enumerate(y)])
    got = {r.k: r.picks for r in extremes.extreme_sets(rows, ["k"], "id", "s", 5, whole=40).collect()}
    assert got == {1: kernels.max_distance(x[None], 5)[0].tolist(), 2: kernels.max_distance(y[None], 5)[0].tolist()}


def test_extremes_of_nothing(spark, whole):
    assert extremes.extreme_spectra(cloud(spark, np.zeros((0, 3))), ["k"], "id", "s", 3).count() == 0


def plain_resample(grid, y, x, method):
    def weight(d):
        a = abs(d)
        if method == "bilinear":
            return max(0.0, 1 - a)
        return 1.5 * a**3 - 2.5 * a**2 + 1 if a <= 1 else -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2 if a < 2 else 0.0

    total = n = 0.0
    for i in range(grid.shape[0]):
        for j in range(grid.shape[1]):
            if not np.isnan(grid[i, j]):
                w = weight(i - y) * weight(j - x)
                total, n = total + w * grid[i, j], n + w
    return total / n if abs(n) > 1e-9 else None


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_resample(spark, method):
    grid = np.random.default_rng(8).random((9, 7))
    grid[3, 3] = np.nan
    src = spark.createDataFrame([(i, j, None if np.isnan(grid[i, j]) else float(grid[i, j])) for i in range(9) for j in range(7)], "y int, x int, v double")
    at = [(i, j, i * 0.9 + 0.2, j * 1.1) for i in range(9) for j in range(6)] + [(50, 50, 40.0, 40.0)]
    got = {(r.ty, r.tx): r.v for r in stacks.resample(src, "v", spark.createDataFrame(at, "ty int, tx int, y double, x double"), method).collect()}
    want = {(a, b): plain_resample(grid, y, x, method) for a, b, y, x in at}
    want = {k: v for k, v in want.items() if v is not None}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def scenes(spark, rows):
    return spark.createDataFrame(rows, "k long, scene long, us long, epsg int, good array<boolean>, x0 double, y0 double, x1 double, y1 double")


def test_sensor_stack(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    a = [(1, 10, 0, 7, [True, True], *box), (1, 11, 60, 7, [True, False], *box), (1, 12, 121, 7, [True, True], *box), (1, 13, 130, 9, [True, True], 50.0, 50.0, 51.0, 51.0)]
    pixels = [(10, 0, 0, [1.0, 2.0], 0), (11, 0, 0, [3.0, 4.0], 1), (11, 0, 1, None, 255), (12, 0, 0, [5.0, 6.0], 1), (12, 0, 1, [7.0, 8.0], 255), (13, 0, 0, [9.0, 9.0], 0)]
    px = spark.createDataFrame(pixels, "scene long, y int, x int, spectrum array<double>, mask int")
    out = stacks.sensor_stack(scenes(spark, a), px, ["k"], 60, 2, region=(0.0, 0.0, 5.0, 5.0), low="keep")
    got = {(r.session, r.y, r.x): (r.frame_us, r.coverage, r.spectrum, r.mask) for r in out.collect()}
    # 60 apart is one pass, 61 is not; the later spectrum wins, clear beats flagged
    assert got == {(0, 0, 0): (0, 50.0, [3.0], 0), (0, 0, 1): (0, 50.0, None, 255), (1, 0, 0): (121, 0.0, [5.0], 1), (1, 0, 1): (121, 0.0, [7.0], 255)}
    kept = stacks.sensor_stack(scenes(spark, a + a[:1]), px, ["k"], 60, 2, region=(0.0, 0.0, 5.0, 5.0))
    assert {r.session for r in kept.collect()} == {0}
    with pytest.raises(Exception, match="different grids"):
        stacks.sensor_stack(scenes(spark, a), px, ["k"], 60, 2).collect()


def test_swath_stack(spark):
    points = spark.createDataFrame([("p", "a", 1, 0.0, 0.0, 1.0), ("p", "a", 2, 0.2, 0.0, 2.0), ("p", "b", 3, 1.0, 0.0, 3.0), ("p", "b", 4, 0.0, 0.0, None), ("q", "a", 5, 9.0, 9.0, 5.0)], "pass string, chunk string, p_id long, x double, y double, value double")
    targets = spark.createDataFrame([(1, 0.1, 0.0), (2, -1.0, 0.0)], "t_id long, x double, y double")
    got = {(r["pass"], r.t_id): r.value for r in stacks.swath_stack(points, targets, ["pass"], 1.0).collect()}
    assert got == {("p", 1): 3.0, ("p", 2): 1.0}


def test_colour_image(spark):
    rows = spark.createDataFrame([(1, float(i), 2.0 * i, 3.0) for i in range(101)], "f long, a double, b double, c double")
    got = stacks.colour_image(rows, ["f"], ("a", "b", "c")).orderBy("a").collect()
    assert got[0].red == 0.0 and got[100].green == 1.0 and got[50].red == pytest.approx(0.5)
    assert all(r.blue is None for r in got)
    with pytest.raises(Exception, match="flat band"):
        stacks.colour_image(rows, ["f"], ("a", "b", "c"), on_flat="raise").agg(F.sum("blue")).collect()
