"""Registered queries use every row of their tables."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest

from phenoscope.operators import harmonic, kernels
from phenoscope.plans import detection, registry

from .test_operators import plain_sliding

registry.load()

#: Pixels of the fixture, ten customers each; most lie above any bound that the queries ever had.
PIXELS = (3, 12, 25, 35, 70, 149)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    rng, rows = np.random.default_rng(5), []
    for p in PIXELS:
        days = rng.choice(2400, 40, replace=False)
        rows += [(len(rows) + i, 10 * p + i % 10, datetime.datetime(1992, 1, 1) + datetime.timedelta(int(d)), float(1e5 * (2 + np.cos(2 * np.pi * d / 365.25) + 0.3 * rng.normal()))) for i, d in enumerate(days)]
    folder = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    return folder


def plain(pdf, keys, order, run, schema):
    """``harmonic._per_series`` as a loop over all series, without Spark."""
    out = []
    for key, one in pdf.groupby(keys):
        got = run(one.sort_values(order, kind="stable"))
        got = pd.DataFrame([got]) if isinstance(got, dict) else got
        out.append(got.assign(**dict(zip(keys, key))))
    return pd.concat(out, ignore_index=True)


def cells(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def cell(v):
        return tuple(round(float(x), 6) for x in v) if isinstance(v, (list, np.ndarray)) else None if pd.isna(v) else round(float(v), 6)

    return sorted((tuple(map(cell, row)) for row in df[columns].astype(object).itertuples(index=False)), key=repr)


SERIES = {
    "hrm08_dhr": lambda s: harmonic.dynamic(s, ["pixel"], "t", "v", "ok", window=2.0, bins=40),
    "hrm09_dhr_refined": lambda s: harmonic.dynamic(s, ["pixel"], "t", "v", "ok", window=2.0, bins=40, estimator="nomp", k=1),
    "frq02_distinct_peaks": lambda s: harmonic.dynamic(s, ["pixel"], "t", "v", "ok", window=2.0, bins=40, estimator="ndft"),
    "frq04_refined_frequency": lambda s: harmonic.pooled_frequencies(s, ["pixel"], "t", "v", "nomp"),
    "frq05_sparse_l1": lambda s: harmonic.pooled_frequencies(s, ["pixel"], "t", "v", "bpdn"),
    "frq06_sparse_log": lambda s: harmonic.pooled_frequencies(s, ["pixel"], "t", "v", "cirl"),
    "frq08_alft": lambda s: harmonic.spectral_features(s, ["pixel"], "t", "v", "ok", windows=(0.5, 1.0, 3.0), bins=30),
}


@pytest.mark.parametrize("name", sorted(SERIES))
def test_all_series(spark, orders, monkeypatch, name):
    got = registry.QUERIES[name](spark, orders).toPandas()
    pdf = detection._series(spark, orders).toPandas()
    monkeypatch.setattr(harmonic, "_per_series", plain)
    want = SERIES[name](pdf)
    assert set(got["pixel"]) == set(PIXELS)
    assert cells(got, list(got.columns)) == cells(want, list(got.columns))


def test_sweep_of_all_series(spark, orders, monkeypatch):
    got = {(r.periods, r.linear): (r.mean_rmse, r.changes) for r in registry.QUERIES["hrm07_configuration_sweep"](spark, orders).collect()}
    pdf = detection._series(spark, orders).toPandas()
    monkeypatch.setattr(harmonic, "_per_series", plain)
    assert len(got) == 6
    for periods in ((1.0,), (1.0, 0.5), (1.19, 1.499, 1.0)):
        for linear in (False, True):
            each = harmonic.harmonized(pdf, ["pixel"], "t", "v", "ok", periods=periods, linear=linear)
            error, changes = got[str(periods), linear]
            assert error == pytest.approx(each["mean_rmse"].mean(), rel=1e-9) and changes == each["change_count"].sum()


@pytest.fixture(scope="module")
def rasters(spark, tmp_path_factory):
    """Two full frames of 500 vectors and 1,900 parts."""
    rng, folder = np.random.default_rng(6), str(tmp_path_factory.mktemp("rasters"))
    vectors = rng.random((1000, 12)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i, int(s)) for i, s in enumerate(rng.integers(1, 51, 1900))], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder, vectors[:, :10].astype(float)


def test_tiles_of_all_vectors(spark, rasters):
    folder, vectors = rasters
    cube = vectors.reshape(50, 20, 10)
    got = {(r.ty, r.tx): r.value for r in registry.QUERIES["win01_tile_complexity"](spark, folder).collect()}
    want = {(y, x): kernels.complexity(cube[4 * y : 4 * y + 4, 4 * x : 4 * x + 4].reshape(1, 16, 10), 7)[0] for y in range(12) for x in range(5)}
    assert {k: v for k, v in got.items() if k[0] < 12} == pytest.approx(want) and len(got) == 65
    tiles = {r.tile for r in registry.QUERIES["win07_legacy_reductions"](spark, folder).collect()}
    assert tiles == set(range(10))


@pytest.mark.parametrize("name", ["win02_sliding_complexity", "win04_sliding_use_rest", "win03_cube_complexity_zscores"])
def test_windows_over_all_vectors(spark, rasters, name):
    folder, vectors = rasters
    got = registry.QUERIES[name](spark, folder).toPandas()
    if name == "win03_cube_complexity_zscores":
        assert sorted(got["frame_idx"].value_counts().items()) == [(f, 500) for f in range(4)]
        got = got[got["frame_idx"] % 2 == 0].assign(frame=lambda d: d["frame_idx"] // 2)
    assert len(got) == 1000
    if name != "win04_sliding_use_rest":
        for f in (0, 1):
            want = plain_sliding(vectors.reshape(2, 25, 20, 10)[f], 3, 1, 7, np.ones((25, 20), bool))
            one = got[got["frame"] == f]
            assert {(y, x): v for y, x, v in zip(one["y"], one["x"], one["complexity"])} == pytest.approx(want)


def test_shifts_of_all_rasters(spark, rasters):
    got = registry.QUERIES["det11_frame_shifts"](spark, rasters[0]).toPandas()
    assert sorted(got["pair"]) == [1, 2, 3, 6, 7, 8, 11, 12, 13]
    assert got["dy"].abs().round(3).eq(1).all() and got["dx"].abs().round(3).eq(2).all()
