"""Extreme pixels and patches against plain searches."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoscope.model import Cube
from phenoscope.operators import candidates


def frames(seed=1, n=3, h=23, w=19):
    rng = np.random.default_rng(seed)
    bad = rng.random((n, h, w)) < 0.02
    return rng.normal(size=(n, h, w)).round(1), bad


def as_rows(spark, value, bad):
    data = [(f, y, x, float(value[f, y, x]), None if bad[f, y, x] and (x + y) % 2 else bool(bad[f, y, x])) for f, y, x in np.ndindex(*bad.shape)]
    return spark.createDataFrame(data, "f int, y int, x int, v double, bad boolean").repartition(5)


def clear(bad, distance):
    out = np.zeros(bad.shape, bool)
    for f, y, x in np.ndindex(*bad.shape):
        q = np.argwhere(bad[f])
        out[f, y, x] = not bad[f, y, x] and (not len(q) or math.sqrt(((q - (y, x)) ** 2).sum(1).min()) >= distance)
    return out


@pytest.mark.parametrize("distance", [1, 2.0, 2.5, 5])
def test_erosion_equals_plain_distances(spark, distance):
    value, bad = frames()
    got = {(r.f, r.y, r.x) for r in candidates.eroded(as_rows(spark, value, bad), ["f"], "bad", distance).collect()}
    assert got == {tuple(map(int, p)) for p in np.argwhere(clear(bad, distance))}


def test_extremes_equal_plain_search(spark):
    value, bad = frames(2, 5)
    value[1, 5, 5], value[2, 6, 6] = math.inf, math.nan
    bad[3] = True
    odd = bad | ~np.isfinite(value)
    ok = clear(odd, 2.0)
    ok[:, :2], ok[:, -2:], ok[:, :, :2], ok[:, :, -2:] = False, False, False, False
    ends = set()
    for f in range(5):
        at = [(float(value[f, y, x]), y, x) for y, x in np.argwhere(ok[f]).tolist()]
        if at:
            hi, lo = max(at, key=lambda p: (p[0], -p[1], -p[2])), min(at)
            ends |= {(f, *p[1:], p[0]) for p in (hi, lo)}
    rows = candidates.frame_extremes(as_rows(spark, value, bad), ["f"], "v", "bad", 23, 19, separation=2, chip=3, top=3).collect()
    for side, sign in (("high", -1), ("low", 1)):
        want = sorted(ends, key=lambda e: (sign * e[3], e[:3]))[:3]
        assert [(r.f, r.y, r.x, r.v) for r in sorted(rows, key=lambda r: r["rank"]) if r.side == side] == want
    assert candidates.frame_extremes(as_rows(spark, value, bad).limit(0), ["f"], "v", "bad", 23, 19).count() == 0


def test_extremes_of_a_cube(spark):
    rng = np.random.default_rng(3)
    data = [(f, y, x, rng.random(6).tolist(), False) for f in range(2) for y in range(12) for x in range(12)]
    cube = Cube(spark.createDataFrame(data, "frame_idx int, y int, x int, spectrum array<double>, invalid boolean"), None, 12, 12)
    rows = cube.extremes(top=1, separation=2, chip=2, size=3, count=5)
    v = np.full((2, 12, 12), np.nan)
    for r in cube.complexity(size=3, count=5).collect():
        v[r.frame_idx, r.y, r.x] = np.nan if r.complexity is None else r.complexity
    # pixels without a window count as masked
    ok = clear(~np.isfinite(v), 2.0)
    ok[:, :2], ok[:, -2:], ok[:, :, :2], ok[:, :, -2:] = False, False, False, False
    got = {r.side: r.complexity for r in rows.collect()}
    assert ok.any() and got["high"] == pytest.approx(v[ok].max()) and got["low"] == pytest.approx(v[ok].min())


@pytest.mark.parametrize("each", [1, 3, 50])
def test_places_are_the_smallest_hashes(spark, each):
    rng = np.random.default_rng(4)
    data = [(y, x, None if rng.random() < 0.05 else int(rng.random() < 0.1)) for y in range(40) for x in range(50)]
    df = spark.createDataFrame(data, "y int, x int, kind int")
    got = {(r.kind, r.patch): (r.y, r.x) for r in candidates.draw_places(df, "kind", each, seed=3).collect()}
    want = {}
    for kind in {k for *_, k in data}:
        order = sorted((int(hashlib.sha256(f"3:{y}:{x}".encode()).hexdigest()[:12], 16), y, x) for y, x, k in data if k == kind)
        want |= {(kind, i): p[1:] for i, p in enumerate(order[:each], 1)}
    assert got == want


def test_patches_equal_slices(spark):
    image = np.arange(30 * 27).reshape(30, 27)
    pixels = spark.createDataFrame([(y, x, int(image[y, x])) for y in range(30) for x in range(27)], "y int, x int, v int")
    places = spark.createDataFrame([(1, 0, 0), (2, 13, 9), (3, 28, 25), (3, 7, 7)], "patch int, y int, x int")
    got = {(r.y, r.x, r.dy, r.dx): r.v for r in candidates.patches(pixels, places, 5).collect()}
    assert got == {(y, x, i, j): int(image[y + i, x + j]) for _, y, x in [(1, 0, 0), (2, 13, 9), (3, 28, 25), (3, 7, 7)] for i in range(5) for j in range(5) if y + i < 30 and x + j < 27}
    assert candidates.patches(pixels, places.where(F.lit(False)), 5).count() == 0
