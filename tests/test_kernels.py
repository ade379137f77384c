"""NumPy kernels against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from phenoscope.operators import kernels


def plain_maxd(x, count):
    p = x.copy()
    i1, i2 = int(np.linalg.norm(x, axis=1).argmax()), int(np.linalg.norm(x, axis=1).argmin())
    out = [i1, i2]
    for _ in range(2, count):
        d = p[i2] - p[i1]
        if d @ d > 1e-12:
            p = p - np.outer(p @ d, d) / (d @ d)
        i1 = i2
        i2 = int(((p - p[i1]) ** 2).sum(1).argmax())
        out.append(i2)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_extremes(seed):
    x = np.random.default_rng(seed).random((5, 30, 8))
    got = kernels.max_distance(x, 6)
    assert got.tolist() == [plain_maxd(a, 6) for a in x]
    ok = np.ones((5, 30), bool)
    ok[:, :7] = False
    assert (kernels.max_distance(x, 6, ok) >= 7).all()


def test_first_of_equal_spectra():
    x = np.array([[[1.0, 0], [1, 0], [0, 0.1], [0, 0.1]]])
    assert kernels.max_distance(x, 2).tolist() == [[0, 2]]


def test_gram_equals_qr():
    v = np.random.default_rng(1).random((7, 5, 9))
    assert kernels.gram_curve(v) == pytest.approx(kernels.volume_curve(v), rel=1e-7)
    flat = kernels.volume_curve(np.random.default_rng(2).random((3, 6, 4)))
    assert (flat[:, 4:] == 0).all() and (flat[:, :4] > 0).all()


def test_origin_shift_of_min_endmember():
    ends = np.random.default_rng(3).random((2, 5, 8))
    v = kernels.volumes(ends)
    assert v.shape == (2, 5) and (v[:, 0] == 0).all()
    want = kernels.gram_curve(np.delete(ends, 1, 1) - ends[:, 1:2])
    assert v[:, 1:] == pytest.approx(want, rel=1e-7)
    moved = kernels.volumes(ends + 3.0)
    assert moved == pytest.approx(v, rel=1e-9)


def test_clip_legacy():
    assert kernels.clip_legacy(np.array([[-1.0, 0.5], [3.0, 1.5]])).tolist() == [[0, 0.5], [1, 1]]
    with_nan = np.array([[np.nan, -2.0]])
    assert np.isnan(kernels.clip_legacy(with_nan)[0, 0]) and kernels.clip_legacy(with_nan)[0, 1] == -2


def test_frequencies_are_recovered():
    rng = np.random.default_rng(4)
    t = np.sort(rng.random(150) * 4)
    y = 2 * np.cos(2 * np.pi * 1.37 * t) + 0.7 * np.sin(2 * np.pi * 3.1 * t) + 0.01 * rng.normal(size=150)
    freqs = np.linspace(0.2, 4, 100)
    f, _ = kernels.matching_pursuit(t, y, freqs, 2)
    assert sorted(f) == pytest.approx([1.37, 3.1], abs=0.05)
    f, coef = kernels.refined_pursuit(t, y - y.mean(), freqs, 2)
    assert sorted(f) == pytest.approx([1.37, 3.1], abs=5e-3)
    for kind in ("l1", "log"):
        amp = kernels.sparse_spectrum(t, y, freqs, kind, 300)
        assert abs(freqs[amp.argmax()] - 1.37) < 0.05
    peaks = kernels.distinct_peaks(freqs, kernels.spectrum(t, y - y.mean(), freqs), 3)
    assert len(peaks) == 3 and abs(peaks[0] - 1.37) < 0.05


def test_phase_shift():
    a = np.random.default_rng(5).random((32, 32))
    assert kernels.phase_shift(np.roll(a, (3, -5), (0, 1)), a) == (3.0, -5.0)
    assert kernels.phase_shift(np.roll(a, (3, -5), (0, 1)), a, 10) == pytest.approx((3.0, -5.0), abs=0.11)


def test_smoothing_keeps_cubics():
    x = np.arange(40.0)
    y = 0.01 * x**3 - x**2 + 3 * x + 1
    assert kernels.smooth(y) == pytest.approx(y, rel=1e-6, abs=1e-6)


def test_splines_sum_to_one():
    b = kernels.b_splines(np.linspace(400, 2500, 50), 6, 400, 2500)
    assert b.sum(1) == pytest.approx(np.ones(50))
