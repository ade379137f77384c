"""Harmonic fits of all trailing windows of a series at once.

Sums of ``cos``, ``sin``, their products and their products with the values over
any window are differences of running sums. On a grid of equal steps the products
of two grid frequencies lie on the grids of their sums and differences, so three
tables of running sums give every window's spectrum and normal equations, for
whatever frequencies each window picks.
"""

from __future__ import annotations

import numpy as np

#: Windows that are solved together; with their observations they set the memory.
BLOCK = 1024


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((1, *x.shape[1:]), x.dtype), np.cumsum(x, 0)))


class Fits:
    """What a batch of windows ``[lo, hi)`` of one series has picked and fitted:
    ``picks`` (windows x k, places on the grid), ``gram``, ``right``, ``coef``
    (``[b0, (cos, sin) * k]`` of times from 0), ``n``, ``total``, ``squares``."""

    def __init__(self, t: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, freqs: np.ndarray, k: int, ridge: float, centred: bool):
        bins, step = len(freqs), (freqs[1] - freqs[0] if len(freqs) > 1 else 0.0)
        turn = lambda f: np.exp(-2j * np.pi * t[:, None] * f)
        part = lambda x: (s := _running(x))[hi] - s[lo]
        # one table of steps: the grid and its sums begin at once and twice the first frequency
        steps, first = turn(np.arange(2 * bins - 1) * step), turn(freqs[:1])
        line = first * steps[:, :bins]
        self.line, self.apart = part(line), part(steps[:, :bins])
        self.joint = part(first * first * steps)
        self.values = part(line * y[:, None])
        self.n, self.total, self.squares = hi - lo, part(y), part(y * y)
        self.rows, self.bins = np.arange(len(lo)), bins
        mean = self.total / np.maximum(self.n, 1)
        seen = self.values - mean[:, None] * self.line
        target = seen if centred else self.values
        self.picks = np.zeros((len(lo), 0), np.int64)
        for _ in range(k):
            best = np.abs(seen).argmax(1) if len(lo) else np.zeros(0, np.int64)
            self.picks = np.concatenate((self.picks, best[:, None]), 1)
            self._normal()
            right = self.right - mean[:, None] * self.gram[:, :, 0] if centred else self.right
            coef = self._solved(ridge, right)
            seen = target - self._spectrum(coef)
        self.coef = self._solved(ridge, self.right)

    def _of(self, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums at grid places; those below zero are conjugates."""
        out = table[self.rows[:, None] if at.ndim == 2 else self.rows, np.abs(at)]
        return np.where(at < 0, np.conj(out), out)

    def _normal(self) -> None:
        k = self.picks.shape[1]
        g = np.zeros((len(self.rows), 1 + 2 * k, 1 + 2 * k))
        b = np.zeros((len(self.rows), 1 + 2 * k))
        g[:, 0, 0], b[:, 0] = self.n, self.total
        for i in range(k):
            p, c, s = self.picks[:, i], 1 + 2 * i, 2 + 2 * i
            one, y = self._of(self.line, p), self._of(self.values, p)
            g[:, 0, c] = g[:, c, 0] = one.real
            g[:, 0, s] = g[:, s, 0] = -one.imag
            b[:, c], b[:, s] = y.real, -y.imag
            for j in range(k):
                q = self.picks[:, j]
                d, a = self._of(self.apart, p - q), self._of(self.joint, p + q)
                g[:, c, 1 + 2 * j] = (d.real + a.real) / 2
                g[:, s, 2 + 2 * j] = (d.real - a.real) / 2
                g[:, c, 2 + 2 * j] = g[:, 2 + 2 * j, c] = (d.imag - a.imag) / 2
        self.gram, self.right = g, b

    def _solved(self, ridge: float, right: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.gram + ridge * np.eye(self.gram.shape[1]), right[..., None])[..., 0] if len(right) else right

    def _spectrum(self, coef: np.ndarray) -> np.ndarray:
        """Spectrum of the fitted curve over the grid."""
        out = coef[:, :1] * self.line
        at = np.arange(self.bins)
        for i in range(self.picks.shape[1]):
            d, a = self._of(self.apart, at - self.picks[:, i : i + 1]), self.joint[self.rows[:, None], at + self.picks[:, i : i + 1]]
            out = out + coef[:, 1 + 2 * i : 2 + 2 * i] * (d + a) / 2 + coef[:, 2 + 2 * i : 3 + 2 * i] * (d - a) / 2j
        return out

    def design(self, t: np.ndarray, freqs: np.ndarray) -> np.ndarray:
        """``[1, (cos, sin) * k]`` of each window at its own times (windows, or
        windows x times)."""
        phase = 2 * np.pi * t[..., None] * (freqs[self.picks] if t.ndim == 1 else freqs[self.picks][:, None, :])
        pairs = np.stack((np.cos(phase), np.sin(phase)), -1).reshape(*t.shape, -1)
        return np.concatenate((np.ones((*t.shape, 1)), pairs), -1)


def blocks(lo: np.ndarray, hi: np.ndarray):
    """Parts of the windows, and the observations that each part needs."""
    for k in range(0, len(lo), BLOCK):
        part = slice(k, k + BLOCK)
        yield part, int(lo[part].min()), int(hi[part].max())


def shares(lo: np.ndarray, hi: np.ndarray):
    """Parts of the windows whose observations are laid out as rows of a table
    of some million cells at most."""
    each = max(1, (1 << 20) // max(1, int((hi - lo).max(initial=1))))
    for a in range(0, len(lo), each):
        yield slice(a, a + each)


def laid_out(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each window's observations, a row each, and which cells count."""
    at = lo[:, None] + np.arange(int((hi - lo).max(initial=1)))
    return np.minimum(at, n - 1), at < hi[:, None]


def medians(x: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Median of each row's cells that count."""
    x = np.sort(np.where(inside, x, np.inf), 1)
    rows, n = np.arange(len(x)), inside.sum(1)
    return (x[rows, (n - 1) // 2] + x[rows, n // 2]) / 2


def sigmas(rest: np.ndarray, inside: np.ndarray, least: float) -> np.ndarray:
    """1.4826 median absolute deviations of each row's cells that count."""
    rest = rest - medians(rest, inside)[:, None]
    return np.maximum(1.4826 * medians(np.abs(rest), inside), least)


def robust_sigma(t: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, fits: Fits, freqs: np.ndarray, least: float) -> np.ndarray:
    """1.4826 median absolute deviations of each window's residuals."""
    out = np.zeros(len(lo))
    for rows in shares(lo, hi):
        at, inside = laid_out(lo[rows], hi[rows], len(t))
        some = object.__new__(Fits)
        some.picks = fits.picks[rows]
        rest = y[at] - np.matmul(some.design(t[at], freqs), fits.coef[rows][..., None])[..., 0]
        out[rows] = sigmas(rest, inside, least)
    return out


def strongest(t: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, freqs: np.ndarray, k: int, apart: float = 0.05, share: float = 0.05) -> np.ndarray:
    """``kernels.distinct_peaks`` of each window's centred spectrum: frequencies
    (windows x k)."""
    line = np.exp(-2j * np.pi * t[:, None] * freqs)
    part = lambda x: (s := _running(x))[hi] - s[lo]
    mean = part(y) / np.maximum(hi - lo, 1)
    amp = np.abs(part(line * y[:, None]) - mean[:, None] * part(line))
    least, rows = share * amp.max(1, initial=0), np.arange(len(lo))
    out, left, going = np.zeros((len(lo), k)), amp.copy(), np.ones(len(lo), bool)
    for i in range(k):
        best = left.argmax(1)
        going &= left[rows, best] > least
        out[:, i] = np.where(going | (i == 0), freqs[best], out[:, i - 1])
        left[np.abs(freqs - out[:, i : i + 1]) < apart] = -np.inf
    return out


def refined(t: np.ndarray, z: np.ndarray, inside: np.ndarray, start: np.ndarray, half: float, steps: int = 30) -> np.ndarray:
    """Golden sections of ``kernels.refined_pursuit`` for all rows together: each
    of a row's frequencies is moved inside its cell to where the fit leaves the
    least of ``z`` (which is 0 outside). What a frequency explains beside the
    others is told by orthogonal columns, so one sine and cosine a step do."""
    dot = lambda a, b: np.einsum("nl,nl->n", a, b)[:, None]

    def unit(column: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
        size = dot(column, column)
        for b in basis:
            column = column - dot(column, b) * b
        left = dot(column, column)
        return column * np.where(left > 1e-26 * size, 1 / np.sqrt(np.maximum(left, 1e-300)), 0.0)

    def pair(f: np.ndarray, basis: list[np.ndarray]) -> list[np.ndarray]:
        phase = (2 * np.pi * f)[:, None] * t
        c = unit(np.cos(phase) * inside, basis)
        return [c, unit(np.sin(phase) * inside, [*basis, c])]

    picked, ratio = start.copy(), (np.sqrt(5) - 1) / 2
    for i in range(picked.shape[1]):
        basis = [unit(inside.astype(float), [])]
        for j in range(picked.shape[1]):
            basis += pair(picked[:, j], basis) if j != i else []
        rest = z
        for b in basis:
            rest = rest - dot(rest, b) * b
        explained = lambda f: sum(dot(rest, c)[:, 0] ** 2 for c in pair(f, basis))  # noqa: B023, E731
        lo, hi = np.maximum(picked[:, i] - half, 1e-6), picked[:, i] + half
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        at_a, at_b = explained(a), explained(b)
        for step in range(steps):
            left = at_a > at_b
            lo, hi = np.where(left, lo, a), np.where(left, b, hi)
            if step == steps - 1:
                break
            new = np.where(left, hi - ratio * (hi - lo), lo + ratio * (hi - lo))
            at_new = explained(new)
            a, b = np.where(left, new, b), np.where(left, a, new)
            at_a, at_b = np.where(left, at_new, at_b), np.where(left, at_a, at_new)
        picked[:, i] = (lo + hi) / 2
    return picked
