"""Queries of review round 4 on tables that used to be too large."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoscope.operators import registration, zscore


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_scores_do_not_drift(spark, keys):
    """Means by sums of doubles were off in the 14th digit for a large group,
    which turns the last of seven places where a score lies between two."""
    rows = spark.range(400_000, numPartitions=3).select("id", F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(50_000)) / 100 + 1e4).alias("v"))
    got = zscore.log_zscore(rows, "v", keys).toPandas()
    x = np.log(got["v"].to_numpy().astype(np.longdouble))
    want = (x - x.mean()) / x.std(ddof=1)
    assert float(np.abs(got["z"] - want).max()) < 2e-12


def test_scores_of_odd_groups(spark):
    """One row, equal rows, endless values, tiny differences."""
    groups = {"one": [3.0], "flat": [2.0] * 5, "inf": [1.0, 2.0, float("inf")], "near": [1e5, 1e5 + 1e-6, 1e5 + 2e-6], "none": [-1.0, None]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {}
    for r in zscore.log_zscore(rows, "v", ["k"]).collect():
        got.setdefault(r.k, []).append(r.z)
    assert got["one"] == [None] and got["flat"] == [None] * 5 and got["none"] == [None, None] and np.isnan(got["inf"]).all()
    assert sorted(got["near"]) == pytest.approx([-1, 0, 1], abs=1e-2)


def test_tiles_of_pixels(spark):
    """Negative and missing places, null, endless and unknown values, pixels
    that come twice: tiles give the pixels back."""
    rows = [("a", 1, y, x, v, ok) for y, x, v, ok in ((0, 0, 1.5, True), (-1, 3, 2.0, True), (15, 16, None, True), (40, 2, float("nan"), True), (41, 2, float("inf"), True))]
    rows += [("a", 2, 3, 4, 7.0, False), ("a", 2, 3, 5, 7.0, None), ("b", 1, 9, 9, 3.0, True), ("b", 1, 9, 9, 4.0, True), ("b", 1, None, 9, 4.0, True), (None, 1, 9, 9, 5.0, True)]
    df = spark.createDataFrame(rows, "k string, f int, y int, x int, v double, ok boolean")
    got = registration.pixels(registration.tiled(df, ["k"], "f", "v", "ok"), ["k"]).collect()
    known = {(r.k, r.frame, r.y, r.x): r.v if r.ok else None for r in got}
    assert len(got) == len(known) == 9
    assert known == {("a", 1, 0, 0): 1.5, ("a", 1, -1, 3): 2.0, ("a", 1, 15, 16): None, ("a", 1, 40, 2): None, ("a", 1, 41, 2): float("inf"), ("a", 2, 3, 4): None, ("a", 2, 3, 5): None, ("b", 1, 9, 9): 4.0, (None, 1, 9, 9): 5.0}


def test_frames_travel_in_tiles(spark, tmp_path):
    """A scene's frames are 64 rows, not 16,384; bumps are drawn as their
    formula says, and pixels register as tiles do."""
    from phenoscope.plans import detection

    keys = range(200, 400)
    spark.createDataFrame([(k, 900.0 + k) for k in keys], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    tiles = detection._lit_tiles(spark, str(tmp_path))
    assert tiles.count() == 4 * 16
    frames = registration.pixels(tiles, ["scene"]).toPandas()
    at = spark.range(200, 400).select(*[(F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(8000)) / 100 - 8).alias(c) for s, c in ((1, "by"), (2, "bx"))], (F.col("id") / 1000 + 0.9).alias("light")).toPandas()
    t = np.deg2rad(1.5)
    for f, y, x, v, ok in frames.sample(300, random_state=1)[["frame", "y", "x", "v", "ok"]].itertuples(index=False):
        assert ok == (np.hypot(y - 20 - 8 * f, x - 40 + 6 * f) >= (60 if f == 3 else 9))
        x0 = x - 10 * (f == 2)
        u, w = x0 - 32, y - 32
        sy, sx = (33.3 + np.sin(t) * u + np.cos(t) * w, 31.3 + np.cos(t) * u - np.sin(t) * w) if f in (1, 2) else (y, x)
        near = (abs(y - np.floor(at["by"])) <= 9) & (abs(x0 - np.floor(at["bx"])) <= 9) & (f < 3)
        if ok:
            assert v == pytest.approx((at["light"] * np.exp(-((sy - at["by"]) ** 2 + (sx - at["bx"]) ** 2) / 8))[near].sum(), abs=1e-12)
    told = lambda df: sorted(df.drop("scene").collect())
    want = told(registration.register_tiles(tiles, ["scene"], span=48))
    found = registration.register_frames(detection._lit_frames(spark, str(tmp_path)), ["scene"], "frame", "v", "ok", span=48)
    assert told(found) == want and [r.verdict for r in want] == ["ok", "too far", "no overlap"]


def test_fits_work_out_once_what_stays(monkeypatch):
    """Where a moved image is clear does not depend on the motion's step."""
    rng, made = np.random.default_rng(6), []
    y, x = np.mgrid[:64, :64]
    at = rng.uniform(0, 64, (60, 2))
    a, b = (sum(np.exp(-((y - p) ** 2 + (x - q + d) ** 2) / 18) for p, q in at) for d in (0.0, 1.6))
    whole = registration.Mover
    monkeypatch.setattr(registration, "Mover", lambda *z: made.append(1) or whole(*z))
    ok = np.ones(a.shape, bool)
    assert registration.rigid_fit(a, b, ok, ok)[:3] == pytest.approx((0, 1.6, 0), abs=0.01) and len(made) == 1
