"""NumPy kernels on batches; no Spark here.

Spectra are ``(batch, pixels, bands)``; everything is float64.
"""

from __future__ import annotations

import math

import numpy as np

TINY = 1e-12


def clip_legacy(x: np.ndarray) -> np.ndarray:
    """To [0, 2] if anything is negative, then to [0, 1] if anything exceeds 1;
    frames with a NaN are left alone."""
    low, high = x.min(), x.max()
    if low < 0:
        x = np.clip(x, 0, 2)
        high = x.max()
    return np.clip(x, 0, 1) if high > 1 else x


def max_distance(x: np.ndarray, count: int, valid: np.ndarray | None = None, unit: bool = False) -> np.ndarray:
    """Indices of ``count`` extreme spectra in each batch entry: the longest,
    the shortest, then, after projecting out the direction between the last
    two, always the farthest from the last. First of equals. ``unit`` scales
    the spectra to length one after the first two are chosen."""
    b, n, _ = x.shape
    rows = np.arange(b)
    ok = np.ones((b, n), bool) if valid is None else valid
    size = (x**2).sum(2)
    first = np.where(ok, size, -np.inf).argmax(1)
    second = np.where(ok, size, np.inf).argmin(1)
    p = x / np.sqrt(np.maximum(size, TINY))[..., None] if unit else x.copy()
    out = np.empty((b, count), np.int64)
    out[:, 0] = first
    if count > 1:
        out[:, 1] = second
    for k in range(2, count):
        d = p[rows, second] - p[rows, first]
        norm = (d**2).sum(1)
        share = np.einsum("bnc,bc->bn", p, d) / np.where(norm > TINY, norm, 1)[:, None]
        p = p - np.where(norm > TINY, 1.0, 0.0)[:, None, None] * share[..., None] * d[:, None]
        first = second
        away = ((p - p[rows, first][:, None]) ** 2).sum(2)
        second = np.where(ok, away, -np.inf).argmax(1)
        out[:, k] = second
    return out


def steps_until(ends: np.ndarray, stop: float) -> int:
    """How many extreme spectra were found before the direction between the
    last two, the earlier directions projected out, came to a squared length of
    ``stop``."""
    dirs, steps = [], min(2, len(ends))
    for k in range(2, len(ends)):
        way = ends[k - 1] - ends[k - 2]
        for u in dirs:
            way = way - u * (way @ u)
        norm = way @ way
        if norm <= stop:
            break
        dirs += [way / np.sqrt(norm)] if norm > TINY else []
        steps += 1
    return steps


def farthest_from_hull(x: np.ndarray, count: int, stop: float = 0.0) -> np.ndarray:
    """Extreme spectra of one set by distance to the affine hull of those found
    (longest first, then the farthest); fewer if the distance squared falls to
    ``stop``."""
    picked = [int((x**2).sum(1).argmax())]
    base = x - x[picked[0]]
    rest = base.copy()
    while len(picked) < count:
        away = (rest**2).sum(1)
        k = int(away.argmax())
        if away[k] <= stop:
            break
        picked.append(k)
        q, _ = np.linalg.qr(base[picked[1:]].T)
        rest = base - base @ q @ q.T
    return np.array(picked)


def volume_curve(vectors: np.ndarray) -> np.ndarray:
    """Volumes of the parallelotopes of the first 1, 2, ... vectors
    ``(batch, vectors, bands)``: running products of the diagonal of R. Beyond
    the number of bands they are 0."""
    r = np.linalg.qr(np.swapaxes(vectors, 1, 2), mode="r")
    diagonal = np.abs(np.diagonal(r, axis1=1, axis2=2))
    out = np.zeros(vectors.shape[:2])
    out[:, : diagonal.shape[1]] = np.cumprod(diagonal, 1)
    return out


def gram_curve(vectors: np.ndarray) -> np.ndarray:
    """The same by determinants of Gram matrices."""
    g = vectors @ np.swapaxes(vectors, 1, 2)
    return np.stack([np.sqrt(np.maximum(np.linalg.det(g[:, :i, :i]), 0)) for i in range(1, g.shape[1] + 1)], 1)


def volumes(ends: np.ndarray, origin: str = "minEndmember", mean: np.ndarray | None = None, curve=volume_curve) -> np.ndarray:
    """Volume curve of extreme spectra ``(batch, count, bands)``.

    ``origin``: ``zero``; ``datasetMean`` (give ``mean``); ``endmemberMean``;
    ``closestToMean`` (centres on the endmember nearest their mean and drops
    it); ``minEndmember`` (centres on the second, drops it and puts a 0 first).
    """
    if origin == "zero":
        return curve(ends)
    if origin == "datasetMean":
        return curve(ends - mean[:, None])
    centre = ends.mean(1)
    if origin == "endmemberMean":
        return curve(ends - centre[:, None])
    if origin == "closestToMean":
        near = ((ends - centre[:, None]) ** 2).sum(2).argmin(1)
        rows = np.arange(len(ends))
        keep = np.arange(ends.shape[1])[None] != near[:, None]
        rest = ends[keep].reshape(len(ends), ends.shape[1] - 1, -1)
        return curve(rest - ends[rows, near][:, None])
    rest = np.delete(ends, 1, axis=1) - ends[:, 1:2]
    return np.concatenate([np.zeros((len(ends), 1)), curve(rest)], 1)


def complexity(x: np.ndarray, count: int, origin: str = "minEndmember", by_bands: bool = True, valid: np.ndarray | None = None) -> np.ndarray:
    """One number for each batch entry: the largest volume from the third on,
    each over ``bands ** (m / 2)``; 0 for two extreme spectra or fewer."""
    if count <= 2:
        return np.zeros(len(x))
    at = max_distance(x, count, valid)
    ends = np.take_along_axis(x, at[..., None], 1)
    v = volumes(ends, origin, x.mean(1))
    if by_bands:
        v = v / x.shape[2] ** (np.arange(1, v.shape[1] + 1) / 2)
    return v[:, 2:].max(1)


def least_squares(design: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients (minimum norm where rank is short) and root mean square of
    the residuals."""
    coef, *_ = np.linalg.lstsq(design, y, rcond=None)
    return coef, float(np.sqrt(((y - design @ coef) ** 2).mean())) if len(y) else (coef, 0.0)


def harmonics(t: np.ndarray, periods: list[float], linear: bool = True, quadratic: bool = False, constant: bool = True) -> np.ndarray:
    cols = [np.ones_like(t)] if constant else []
    cols += [t] if linear else []
    cols += [t**2] if quadratic else []
    for p in periods:
        cols += [np.cos(2 * np.pi * t / p), np.sin(2 * np.pi * t / p)]
    return np.stack(cols, 1)


def spectrum(t: np.ndarray, y: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Amplitudes of the non-uniform Fourier transform."""
    return np.abs(np.exp(-2j * np.pi * freqs[:, None] * t) @ y)


def distinct_peaks(freqs: np.ndarray, amp: np.ndarray, k: int, apart: float = 0.05, share: float = 0.05) -> np.ndarray:
    """The strongest frequencies, none closer than ``apart`` to a stronger one
    nor weaker than ``share`` of the strongest; padded with the last."""
    picked: list[float] = []
    for i in np.argsort(-amp, kind="stable"):
        if len(picked) == k or amp[i] <= share * amp.max():
            break
        if all(abs(freqs[i] - f) >= apart for f in picked):
            picked.append(float(freqs[i]))
    picked = picked or [float(freqs[amp.argmax()])]
    return np.array((picked + picked[-1:] * k)[:k])


def matching_pursuit(t: np.ndarray, y: np.ndarray, freqs: np.ndarray, k: int, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies chosen one by one from the residual's spectrum, all
    coefficients refitted after each; returns them and the coefficients
    ``[b0, (cos, sin) * k]``."""
    picked, rest, coef = [], y - y.mean(), None
    for _ in range(k):
        picked.append(float(freqs[spectrum(t, rest, freqs).argmax()]))
        a = harmonics(t, [1 / f for f in picked], linear=False)
        coef = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ y)
        rest = y - a @ coef
    return np.array(picked), coef


def refined_pursuit(t: np.ndarray, y: np.ndarray, freqs: np.ndarray, k: int, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Matching pursuit off the grid: each frequency is moved by golden section
    inside its cell until the residual stops falling."""
    picked, coef = matching_pursuit(t, y, freqs, k)
    half = (freqs[1] - freqs[0]) if len(freqs) > 1 else 0.0

    def error(fs: np.ndarray) -> float:
        a = harmonics(t, list(1 / fs), linear=False)
        c, *_ = np.linalg.lstsq(a, y, rcond=None)
        return float(((y - a @ c) ** 2).sum())

    ratio = (np.sqrt(5) - 1) / 2
    for i in range(k):
        lo, hi = max(picked[i] - half, 1e-6), picked[i] + half
        for _ in range(steps):
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            fa, fb = picked.copy(), picked.copy()
            fa[i], fb[i] = a, b
            if error(fa) < error(fb):
                hi = b
            else:
                lo = a
        picked[i] = (lo + hi) / 2
    a = harmonics(t, list(1 / picked), linear=False)
    coef, *_ = np.linalg.lstsq(a, y, rcond=None)
    return picked, coef


def sparse_spectrum(t: np.ndarray, y: np.ndarray, freqs: np.ndarray, penalty: str = "l1", steps: int = 800, share: float = 0.15) -> np.ndarray:
    """Amplitudes of a sparse fit by proximal gradients: an L1 penalty, or the
    log-sum penalty (reweighted L1) for ``penalty='log'``."""
    return sparse_spectra([t], [y], freqs, penalty, steps, share)[0]


def sparse_spectra(times: list[np.ndarray], values: list[np.ndarray], freqs: np.ndarray, penalty: str = "l1", steps: int = 800, share: float = 0.15) -> np.ndarray:
    """``sparse_spectrum`` of several series together, a row each."""
    half = len(freqs)
    # steps run on the products; their largest eigenvalue is the squared norm
    gram, right, rate = np.zeros((len(times), 2 * half, 2 * half)), np.zeros((len(times), 2 * half)), np.zeros((len(times), 1))
    for i, (t, y) in enumerate(zip(times, values, strict=True)):
        phase = 2 * np.pi * t[:, None] * freqs
        a = np.concatenate([np.cos(phase), np.sin(phase)], 1)
        gram[i], right[i] = a.T @ a, a.T @ (y - y.mean())
        rate[i] = 1 / max(np.linalg.eigvalsh(gram[i] if len(t) > 2 * half else a @ a.T)[-1], TINY)
    weight = share * np.abs(right).max(1, keepdims=True, initial=0)
    gram, right, fixed = gram * rate[..., None], right * rate, weight * rate
    x, last, m = np.zeros_like(right), np.zeros_like(right), 1.0
    for step in range(steps):
        eps = 1e-3 if step < steps // 2 else 1e-4
        bound = fixed * eps / (np.abs(x) + eps) if penalty == "log" else fixed
        new = last - np.matmul(gram, last[..., None])[..., 0] + right
        new -= np.minimum(np.maximum(new, -bound), bound)
        m2 = (1 + math.sqrt(1 + 4 * m * m)) / 2
        last, x, m = new + (m - 1) / m2 * (new - x), new, m2
    return np.hypot(x[:, :half], x[:, half:])


def phase_shift(a: np.ndarray, b: np.ndarray, upsample: int = 1) -> tuple[float, float]:
    """Row and column shift of ``b`` against ``a`` by phase correlation, with
    the peak refined to ``1 / upsample`` of a pixel by a matrix transform."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    f /= np.maximum(np.abs(f), TINY)
    peak = np.abs(np.fft.ifft2(f))
    at = np.array(np.unravel_index(peak.argmax(), peak.shape), float)
    size = np.array(a.shape)
    at[at > size // 2] -= size[at > size // 2]
    if upsample > 1:
        span = np.arange(-upsample, upsample + 1) / upsample
        fy, fx = np.fft.fftfreq(size[0]), np.fft.fftfreq(size[1])
        left = np.exp(2j * np.pi * (at[0] + span)[:, None] * fy)
        right = np.exp(2j * np.pi * fx[:, None] * (at[1] + span))
        fine = np.abs(left @ f @ right)
        i, j = np.unravel_index(fine.argmax(), fine.shape)
        at += span[[i, j]]
    return float(at[0]), float(at[1])


def smooth(y: np.ndarray, window: int = 15, degree: int = 3) -> np.ndarray:
    """Savitzky-Golay: local polynomials; the ends take the first and last
    window's polynomial."""
    n, half = len(y), window // 2
    if n < window:
        return y.copy()
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], "same")
    for part, at in ((slice(0, window), np.arange(half)), (slice(n - window, n), np.arange(half + 1, window))):
        value = np.vander(x[at], degree + 1, increasing=True) @ (fit @ y[part])
        out[np.arange(n)[part][at]] = value
    return out


def functional_complexity(spectra: np.ndarray, waves: np.ndarray, weights: np.ndarray, splines: int = 6, ridge: float = 1e-4, low: float = 400.0, high: float = 2500.0) -> float:
    """Spread of spectra as functions: cubic B-spline coefficients by weighted
    ridge regression, centred, and the square root of the trace of their
    covariance in the splines' inner product."""
    grid = np.linspace(low, high, 1001)
    basis = b_splines(waves, splines, low, high)
    w = weights[:, None]
    coef = np.linalg.solve(basis.T @ (w * basis) + ridge * np.eye(splines), basis.T @ (w * spectra.T)).T
    on_grid = b_splines(grid, splines, low, high)
    inner = np.trapezoid(on_grid[:, :, None] * on_grid[:, None], grid, axis=0) / (high - low)
    z = (coef - coef.mean(0)) @ np.linalg.cholesky(inner + TINY * np.eye(splines))
    return float(np.sqrt(np.trace(z.T @ z) / max(1, len(z) - 1)))


def functional_weights(waves: np.ndarray, weights: np.ndarray, splines: int = 6, ridge: float = 1e-4, low: float = 400.0, high: float = 2500.0) -> np.ndarray:
    """The matrix ``(splines, bands)`` that takes a spectrum to the coefficients
    whose summed variances are the squared ``functional_complexity``."""
    grid = np.linspace(low, high, 1001)
    basis = b_splines(waves, splines, low, high)
    fit = np.linalg.solve(basis.T @ (weights[:, None] * basis) + ridge * np.eye(splines), (weights[:, None] * basis).T)
    on_grid = b_splines(grid, splines, low, high)
    inner = np.trapezoid(on_grid[:, :, None] * on_grid[:, None], grid, axis=0) / (high - low)
    return np.linalg.cholesky(inner + TINY * np.eye(splines)).T @ fit


def b_splines(x: np.ndarray, count: int, low: float, high: float, degree: int = 3) -> np.ndarray:
    inner = np.linspace(low, high, count - degree + 1)
    knots = np.concatenate([[low] * degree, inner, [high] * degree])
    x = np.clip(x, low, high - 1e-9 * (high - low))[:, None]
    b = ((knots[:-1] <= x) & (x < knots[1:])).astype(float)
    for d in range(1, degree + 1):
        left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        up = np.where(left > 0, (x - knots[: -d - 1]) / np.where(left > 0, left, 1), 0) * b[:, :-1]
        down = np.where(right > 0, (knots[d + 1 :] - x) / np.where(right > 0, right, 1), 0) * b[:, 1:]
        b = up + down
    return b
