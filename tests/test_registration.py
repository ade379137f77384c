"""Registration against planted shifts and plain searches."""

from __future__ import annotations

import numpy as np
import pytest

from phenoscope.operators import registration as reg


def scene(rng, n=70):
    at, light = rng.uniform(-10, 90, (n, 2)), rng.uniform(0.5, 2, n)
    return lambda y, x: sum(a * np.exp(-((y - p) ** 2 + (x - q) ** 2) / 18) for (p, q), a in zip(at, light, strict=True))


def views(rng, dy, dx, degrees, size=64):
    """A frame, and one that must be moved by the given amounts to lie on it."""
    f, t, c = scene(rng), np.deg2rad(degrees), size // 2
    y, x = np.mgrid[:size, :size].astype(float)
    u, v = x - c, y - c
    return f(y, x), f(c + dy + np.sin(t) * u + np.cos(t) * v, c + dx + np.cos(t) * u - np.sin(t) * v)


def clouds(rng, image, share):
    ok = np.ones(image.shape, bool)
    for _ in range(share):
        y, x = rng.integers(0, 52, 2)
        ok[y : y + 12, x : x + 12] = False
    image[~ok] = 9.0
    return ok


@pytest.mark.parametrize(("dy", "dx", "degrees"), [(0, 0, 0), (1.3, -0.7, 1.5), (-6.4, 3.2, -1.2), (10.0, -12.5, 0.3)])
def test_planted_shift_and_turn_come_back(dy, dx, degrees):
    rng = np.random.default_rng(1)
    a, b = views(rng, dy, dx, degrees)
    ok_a, ok_b = clouds(rng, a, 4), clouds(rng, b, 4)
    got = reg.rigid_fit(a, b, ok_a, ok_b)
    assert got[:3] == pytest.approx((dy, dx, degrees), abs=0.05) and got[3] > 0.99


def test_masked_shift_equals_plain_search():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(14, 14))
    b = np.roll(a, (2, -3), (0, 1))
    ok_a, ok_b = rng.random(a.shape) < 0.8, rng.random(a.shape) < 0.8

    def overlapped(dy, dx):
        u, v = [], []
        for y in range(14):
            for x in range(14):
                p, q = y - dy, x - dx
                if 0 <= p < 14 and 0 <= q < 14 and ok_a[y, x] and ok_b[p, q]:
                    u.append(a[y, x])
                    v.append(b[p, q])
        return u, v

    shared = {(i, j): overlapped(i, j) for i in range(-13, 14) for j in range(-13, 14)}
    most = max(len(u) for u, _ in shared.values())
    score = {k: np.corrcoef(u, v)[0, 1] for k, (u, v) in shared.items() if len(u) >= 0.3 * most}
    assert reg.masked_shift(a, b, ok_a, ok_b) == max(score, key=score.get) == (-2, 3)


def test_simplex_keeps_to_its_bounds():
    f = lambda p: float(((p - np.array([3.0, -0.2])) ** 2).sum())
    p, value = reg.simplex(f, np.zeros(2), np.full(2, 0.5), np.full(2, -1.0), np.full(2, 1.0))
    assert p == pytest.approx([1.0, -0.2], abs=1e-3) and value == pytest.approx(4.0, abs=1e-3)


def rows(spark, frames):
    data = [(0, f, y, x, float(image[y, x]), bool(ok[y, x])) for f, (image, ok) in enumerate(frames) for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(data, "k int, f int, y int, x int, v double, ok boolean")


def test_windows_equal_plain_search(spark):
    rng = np.random.default_rng(3)
    frames = [(rng.normal(size=(30, 41)), rng.random((30, 41)) < 0.9) for _ in range(2)]
    frames[0][0][5:, 20:] *= 3
    got = reg.clearest_windows(reg.frame_pairs(rows(spark, frames), ["k"], "f", "v", "ok"), ["k"], 16).collect()
    best = None
    both = frames[0][1] & frames[1][1]
    for y in range(0, 30 - 16 + 1, 4):
        for x in range(0, 41 - 16 + 1, 4):
            m = both[y : y + 16, x : x + 16]
            key = (m.mean(), frames[0][0][y : y + 16, x : x + 16][m].var())
            if m.mean() >= 0.65 and (best is None or key > best[0]):
                best = (key, y, x)
    assert [(r.y0, r.x0, r.clear) for r in got] == [(*best[1:], pytest.approx(best[0][0]))]


def test_frames_are_registered_in_their_clear_window(spark):
    """Frames larger than the window; a clouded frame has no window, a frame
    far off is told."""
    rng = np.random.default_rng(4)
    a, b = views(rng, 0.8, -1.4, 1.0, 80)
    far = np.zeros_like(b)
    far[:, 12:] = b[:, :-12]
    ok = [np.ones(a.shape, bool) for _ in range(4)]
    ok[0][:16, :16] = False
    ok[2][:, :12] = False
    ok[3][:] = False
    df = rows(spark, [(a, ok[0]), (b, ok[1]), (far, ok[2]), (a, ok[3])])
    got = {r.a_frame: r for r in reg.register_frames(df, ["k"], "f", "v", "ok", span=48).collect()}
    assert [got[k].verdict for k in range(3)] == ["ok", "too far", "no overlap"]
    # about the window's middle, the turn adds to the shift
    cy, cx, t = got[0].y0 + 24 - 40, got[0].x0 + 24 - 40, np.deg2rad(1.0)
    dy, dx = 0.8 + np.sin(t) * cx + np.cos(t) * cy - cy, -1.4 + np.cos(t) * cx - np.sin(t) * cy - cx
    assert (got[0].dy, got[0].dx, got[0].degrees) == pytest.approx((dy, dx, 1.0), abs=0.05)
    assert (got[1].dy, got[1].dx) == pytest.approx((0, -12), abs=0.05) and got[1].offset == pytest.approx(360, abs=2)
    assert got[2].dy is None and reg.register_frames(df.limit(0), ["k"], "f", "v", "ok", span=48).count() == 0
