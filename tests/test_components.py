"""Groups' means, covariances and components against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from phenoscope.operators import components


def data(seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(6, 6))
    out = [(("a", "b", None)[i % 3], i, (1e4 + rng.normal(size=6) @ mix).tolist()) for i in range(300)]
    out += [("c", 900 + i, rng.normal(size=6).tolist()) for i in range(7)]
    return out + [("a", 1000, None), ("b", 1001, [float("nan")] * 6), ("a", 1002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("d", 1003, None)]


def plain(rows, distance):
    out = {}
    for key in {k for k, *_ in rows}:
        mine = [(i, np.array(v, float)) for k, i, v in rows if k == key and v is not None and None not in v]
        mine = [(i, v) for i, v in mine if np.isfinite(v).all()]
        x = np.array([v for _, v in mine]).reshape(len(mine), 6)
        out |= {i: None for k, i, _ in rows if k == key}
        if len(x):
            got = distance(x)
            out |= {i: None if got is None else got[n] for n, (i, _) in enumerate(mine)}
    return out


def mahalanobis(x):
    if len(x) < 8:
        return None
    c = x - x.mean(0)
    return np.sqrt(np.einsum("ni,ij,nj->n", c, np.linalg.inv(np.cov(x.T) + 1e-5 * np.eye(6)), c) / 6)


def leftover(x):
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    return ((c - c @ v[:2].T @ v[:2]) ** 2).mean(1)


@pytest.mark.parametrize("share", [50_000, 40])
@pytest.mark.parametrize("kind", ["distance", "error"])
def test_scores_equal_numpy(spark, monkeypatch, kind, share):
    monkeypatch.setattr(components, "SHARE_ROWS", share)
    rows = data()
    df = spark.createDataFrame(rows, "k string, id long, v array<double>").repartition(7)
    got = components.mahalanobis(df, ["k"], "id", "v") if kind == "distance" else components.reconstruction_error(df, ["k"], "id", "v", 2)
    want = plain(rows, mahalanobis if kind == "distance" else leftover)
    got = {r.id: r[kind] for r in got.collect()}
    assert got.keys() == want.keys()
    assert {i for i, v in got.items() if v is None} == {i for i, v in want.items() if v is None}
    assert {i: v for i, v in got.items() if v is not None} == pytest.approx({i: v for i, v in want.items() if v is not None}, rel=1e-6, abs=1e-8)


def test_parts_are_combined(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) + 5
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(9)
    monkeypatch.setattr(components, "SPREAD", 2)
    row = components.moments(df, [], "v").collect()[0]
    assert row.n == 400 and row.mean == pytest.approx(x.mean(0).tolist())
    assert row.products == pytest.approx((np.cov(x.T) * 399).ravel().tolist())
    assert components.moments(df.limit(0), [], "v").count() == 0
    with pytest.raises(Exception, match="one length"):
        components.moments(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1), [], "v").collect()
