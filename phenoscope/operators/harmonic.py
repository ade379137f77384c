"""Change detection by harmonic regression, per pixel series.

A series is one pixel's observations: its group stays small whatever the
number of pixels. Times are fractional years, ``valid`` marks usable rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import kernels, moments

#: Default periods in years.
PERIODS = (1.19, 1.499, 1.0)


def _per_series(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame], dict | pd.DataFrame], schema: str) -> DataFrame:
    """What ``run`` says of each key's rows in ``order``. Spark deals and sorts
    the rows, so a batch holds many series; a series may go over several.
    Where ``run`` has ``together``, that is asked about some series at once."""
    types = dict(df.dtypes)
    schema = "".join(f"{k} {types[k]}, " for k in keys) + schema
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def told(asked: list[tuple[list, pd.DataFrame]]) -> pa.RecordBatch:
        series = [pdf for _, pdf in asked]
        found = run.together(series) if hasattr(run, "together") else [run(pdf) for pdf in series]
        parts = list(zip([key for key, _ in asked], found, strict=True))
        if isinstance(parts[0][1], dict):
            out = pd.DataFrame([got for _, got in parts], dtype=object)
            sizes = np.ones(len(parts), np.int64)
        else:
            out, sizes = pd.concat([got for _, got in parts], ignore_index=True), np.array([len(got) for _, got in parts])
        at = np.repeat(np.arange(len(parts)), sizes)
        columns = [pa.array([key[i] for key, _ in parts], arrow.field(i).type).take(pa.array(at)) for i in range(len(keys))]
        columns += [pa.Array.from_pandas(out[f.name], type=f.type) for f in list(arrow)[len(keys) :]]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def all_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key_of = lambda b: [b.column(k)[0].as_py() for k in keys]

        def ended() -> tuple[list, pd.DataFrame]:
            return key_of(held[0]), pa.Table.from_batches(held).to_pandas()

        for b in batches:
            if not b.num_rows:
                continue
            fresh = np.zeros(b.num_rows, bool)
            for k in keys:
                fresh[1:] |= np.diff(b.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)) != 0
            fresh[0] = bool(held) and key_of(held[0]) != key_of(b)
            starts = np.flatnonzero(fresh)
            if not len(starts):
                held.append(b)
                continue
            parts, first = [], int(starts[0])
            if first:
                held.append(b.slice(0, first))
            parts.append(ended())
            pdf = b.to_pandas()
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                parts.append((key_of(b.slice(lo, 1)), pdf.iloc[lo:hi]))
            held = [b.slice(int(starts[-1]))]
            yield told(parts)
        if held:
            yield told([ended()])

    # a series costs far more time than bytes, so partitions must not be merged by size
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartition(parts, *keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in order])
    return sorted_rows.mapInArrow(all_series, schema)


def train_and_scan(df: DataFrame, keys: list[str], t: str, y: str, valid: str, end: float, periods=(1.0, 0.5), least: int = 15, factor: float = 3.5, run: int = 3, floor: float = 1e-5) -> DataFrame:
    """Fits the observations before ``end``, then scans the rest: the change is
    where ``run`` valid observations in a row lie beyond ``factor`` times the
    fit's error (invalid ones are passed over)."""

    def series(pdf: pd.DataFrame) -> dict:
        ok = pdf[valid].to_numpy(bool)
        tt, yy = pdf[t].to_numpy(float)[ok], pdf[y].to_numpy(float)[ok]
        old = tt < end
        out = {"rmse": None, "change_at": None, "n_train": int(old.sum())}
        if old.sum() >= least:
            coef, rmse = kernels.least_squares(kernels.harmonics(tt[old], list(periods)), yy[old])
            out["rmse"] = rmse = max(rmse, floor)
            hits = 0
            for when, r in zip(tt[~old], np.abs(yy[~old] - kernels.harmonics(tt[~old], list(periods)) @ coef)):
                start = when if not hits or r <= factor * rmse else start
                hits = hits + 1 if r > factor * rmse else 0
                if hits == run:
                    out["change_at"] = start
                    break
        return out

    return _per_series(df, keys, [t], series, "rmse double, change_at double, n_train long")


def sliding_baseline(df: DataFrame, keys: list[str], t: str, y: str, valid: str, least: int = 15, factor: float = 3.0, run: int = 3, floor: float = 1e-3) -> DataFrame:
    """Starts with ``least`` valid observations and refits on everything so far
    at each one that is normal; stops at the third anomaly in a row."""

    def series(pdf: pd.DataFrame) -> dict:
        ok = pdf[valid].to_numpy(bool)
        tt, yy = pdf[t].to_numpy(float)[ok], pdf[y].to_numpy(float)[ok]
        out = {"change_at": None, "n_fits": 0, "rmse": None}
        if len(tt) < least:
            return out
        fit = lambda k: kernels.least_squares(kernels.harmonics(tt[:k], [1.0, 0.5]), yy[:k])
        coef, rmse = fit(least)
        out["n_fits"], hits, start = 1, 0, None
        for i in range(least, len(tt)):
            off = abs(yy[i] - (kernels.harmonics(tt[i : i + 1], [1.0, 0.5]) @ coef)[0])
            if off > factor * max(rmse, floor):
                start = tt[i] if not hits else start
                hits += 1
                if hits == run:
                    out["change_at"] = float(start)
                    break
            else:
                hits = 0
                coef, rmse = fit(i + 1)
                out["n_fits"] += 1
        out["rmse"] = max(rmse, floor)
        return out

    return _per_series(df, keys, [t], series, "change_at double, n_fits long, rmse double")


def _trailing_fits(tt: np.ndarray, yy: np.ndarray, window: float, least: int, widest: float, periods, linear: bool, quadratic: bool, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the observations that have a trailing window, and for each
    the prediction and the fit's error. All windows are differences of running
    sums of one design, solved together; those near singular one by one."""
    i = np.arange(len(tt))
    lo = np.searchsorted(tt, tt - window)
    short = i - lo < least
    lo = np.where(short, i - least, lo)
    fine = (tt - tt[0] >= window) & (lo >= 0) if len(tt) else np.zeros(0, bool)
    fine &= ~short | (tt - tt[np.maximum(lo, 0)] <= widest)
    i, lo = i[fine], lo[fine]
    if not len(i):
        return i, np.zeros(0), np.zeros(0)
    a = kernels.harmonics(tt - tt.mean(), list(periods), linear, quadratic)
    sums = lambda x: np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)))
    part = lambda x: (s := sums(x))[i] - s[lo]
    g, b, q, n = part(a[:, :, None] * a[:, None]), part(a * yy[:, None]), part(yy**2), i - lo
    root = np.linalg.eigvalsh(g)
    sound = (root[:, -1] < 1e8 * root[:, 0]) & (n > a.shape[1])
    predicted, square = np.zeros(len(i)), np.zeros(len(i))
    if sound.any():
        c = np.linalg.solve(g[sound], b[sound][..., None])[..., 0]
        predicted[sound] = (a[i[sound]] * c).sum(1)
        square[sound] = q[sound] - 2 * (c * b[sound]).sum(1) + np.einsum("ni,nij,nj->n", c, g[sound], c)
    for k in np.flatnonzero(~sound):
        own = kernels.harmonics(tt[lo[k] : i[k] + 1] - tt[i[k]], list(periods), linear, quadratic)
        coef, rmse = kernels.least_squares(own[:-1], yy[lo[k] : i[k]])
        predicted[k], square[k] = own[-1] @ coef, rmse**2 * n[k]
    return i, predicted, np.maximum(np.sqrt(np.maximum(square, 0) / n), floor)


def harmonized_rows(df: DataFrame, keys: list[str], t: str, y: str, valid: str, window: float = 3.0, least: int = 12, widest: float = 5.0, periods=PERIODS, factor: float = 3.0, run: int = 4, floor: float = 1e-5, linear: bool = True, quadratic: bool = False) -> DataFrame:
    """Refits for every valid observation on the trailing ``window`` years (or
    the last ``least`` observations, if they span no more than ``widest``).
    Per row: ``predicted`` and ``rmse`` (null without a fit), ``anomaly``
    (beyond ``factor`` times the error), ``streak`` (anomalies in a row of
    fitted observations) and ``change`` (the streak has reached ``run``)."""

    def series(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = np.flatnonzero(pdf[valid].to_numpy(bool))
        tt, yy = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        i, predicted, rmse = _trailing_fits(tt[ok], yy[ok], window, least, widest, periods, linear, quadratic, floor)
        at = ok[i]
        odd = np.abs(yy[at] - predicted) > factor * rmse
        count = np.cumsum(odd)
        streak = count - np.maximum.accumulate(np.where(odd, 0, count)) if len(i) else count
        out = pd.DataFrame({t: tt, y: yy, "predicted": np.nan, "rmse": np.nan, "anomaly": False, "streak": 0, "change": False})
        for name, values in (("predicted", predicted), ("rmse", rmse), ("anomaly", odd), ("streak", streak), ("change", streak >= run)):
            out.loc[at, name] = values
        return out.astype({"predicted": object, "rmse": object}).where(out.notna(), None)

    return _per_series(df, keys, [t], series, f"{t} double, {y} double, predicted double, rmse double, anomaly boolean, streak long, change boolean")


def harmonized(df: DataFrame, keys: list[str], t: str, y: str, valid: str, run: int = 4, **options) -> DataFrame:
    """Per series what ``harmonized_rows`` finds: the time its first change
    begins, the number of observations in a change, and the mean error."""
    def series(pdf: pd.DataFrame) -> dict:
        return _changes(pdf, t, y, valid, run, **options)

    return _per_series(df, keys, [t], series, "change_at double, change_count long, mean_rmse double")


def sweep(df: DataFrame, keys: list[str], t: str, y: str, valid: str, settings: list[dict], run: int = 4) -> DataFrame:
    """``harmonized`` for several settings in one pass: ``change_count_i`` and
    ``mean_rmse_i`` of setting ``i``."""

    def series(pdf: pd.DataFrame) -> dict:
        return {f"{c}_{i}": v for i, s in enumerate(settings) for c, v in _changes(pdf, t, y, valid, run, **s).items() if c != "change_at"}

    return _per_series(df, keys, [t], series, ", ".join(f"change_count_{i} long, mean_rmse_{i} double" for i in range(len(settings))))


def _changes(pdf: pd.DataFrame, t: str, y: str, valid: str, run: int, window: float = 3.0, least: int = 12, widest: float = 5.0, periods=PERIODS, factor: float = 3.0, floor: float = 1e-5, linear: bool = True, quadratic: bool = False) -> dict:
    ok = pdf[valid].to_numpy(bool)
    tt, yy = pdf[t].to_numpy(float)[ok], pdf[y].to_numpy(float)[ok]
    i, predicted, rmse = _trailing_fits(tt, yy, window, least, widest, periods, linear, quadratic, floor)
    hits, count, first = 0, 0, None
    for k, odd in zip(i.tolist(), (np.abs(yy[i] - predicted) > factor * rmse).tolist()):
        hits = hits + 1 if odd else 0
        if hits >= run:
            count += 1
            first = float(tt[k - run + 1]) if first is None else first
    return {"change_at": first, "change_count": count, "mean_rmse": float(rmse.mean()) if len(i) else None}


def _dynamic_fits(tt: np.ndarray, yy: np.ndarray, ok: np.ndarray, freqs: np.ndarray, window: float, min_span: float, least: int, k: int, ridge: float, estimator: str = "omp") -> dict[str, np.ndarray]:
    """Predictions, standard errors, frequencies and amplitudes of all
    observations that have a trailing window: by running sums for frequencies
    of the grid, else by tables with a row a window."""
    out = {"at": np.zeros(0, np.int64), "predicted": np.zeros(0), "bound": np.zeros(0), "frequency": np.zeros((0, k)), "amplitude": np.zeros((0, k))}
    if not ok.any():
        return out
    t, y = tt[ok], yy[ok]
    lo, hi = np.searchsorted(t, tt - window, "left"), np.searchsorted(t, tt, "left")
    fine = (tt - t[0] >= min_span) & (hi - lo >= max(least, 1))
    fine[fine] = (t[hi[fine] - 1] - t[lo[fine]]) >= min_span
    at, lo, hi = np.flatnonzero(fine), lo[fine], hi[fine]
    parts = []
    for part, first, last in moments.blocks(lo, hi):
        base, v = t[first:last] - t[first], y[first:last]
        a, z, target = lo[part] - first, hi[part] - first, tt[at[part]] - t[first]
        if estimator != "omp":
            parts += [_laid_out_fits(base, v, a[r], z[r], target[r], freqs, k, ridge, estimator) for r in moments.shares(a, z)]
            continue
        fits = moments.Fits(base, v, a, z, freqs, k, ridge, centred=True)
        sigma = moments.robust_sigma(base, v, a, z, fits, freqs, 1e-6)
        x = fits.design(target, freqs)
        spread = np.linalg.solve(fits.gram + ridge * np.eye(x.shape[1]), x[..., None])[..., 0]
        pairs = fits.coef[:, 1:].reshape(len(x), k, 2)
        parts.append(((x * fits.coef).sum(1), sigma * np.sqrt(1 + (x * spread).sum(1)), freqs[fits.picks], np.hypot(pairs[..., 0], pairs[..., 1])))
    if parts:
        out = {"at": at, **{n: np.concatenate(c) for n, c in zip(("predicted", "bound", "frequency", "amplitude"), zip(*parts, strict=True), strict=True)}}
    return out


def _laid_out_fits(t: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray, freqs: np.ndarray, k: int, ridge: float, estimator: str) -> tuple[np.ndarray, ...]:
    """``predicted, bound, frequency, amplitude`` of windows whose frequencies
    are refined off the grid (``nomp``) or distinct peaks (``ndft``)."""
    at, inside = moments.laid_out(lo, hi, len(t))
    when, v = t[at] - target[:, None], np.where(inside, y[at], 0.0)
    if estimator == "nomp":
        start = freqs[moments.Fits(t, y, lo, hi, freqs, k, 1e-5, centred=True).picks]
        centred = np.where(inside, v - (v.sum(1) / (hi - lo))[:, None], 0.0)
        f = moments.refined(when, centred, inside, start, freqs[1] - freqs[0] if len(freqs) > 1 else 0.0)
    else:
        f = moments.strongest(t, y, lo, hi, freqs, k)
    phase = 2 * np.pi * when[..., None] * f[:, None, :]
    pairs = np.stack((np.cos(phase), np.sin(phase)), -1).reshape(*when.shape, -1)
    a = np.concatenate((np.ones((*when.shape, 1)), pairs), -1) * inside[..., None]
    x = np.tile([1.0] + [1.0, 0.0] * k, (len(lo), 1))
    turned = np.swapaxes(a, 1, 2)
    both = np.linalg.solve(turned @ a + ridge * np.eye(1 + 2 * k), np.concatenate((turned @ v[..., None], x[..., None]), 2))
    coef, spread = both[..., 0], both[..., 1]
    sigma = moments.sigmas(v - (a @ coef[..., None])[..., 0], inside, 1e-6)
    pairs = coef[:, 1:].reshape(len(x), k, 2)
    return (x * coef).sum(1), sigma * np.sqrt(1 + (x * spread).sum(1)), f, np.hypot(pairs[..., 0], pairs[..., 1])


def dynamic_rows(df: DataFrame, keys: list[str], t: str, y: str, valid: str, window: float = 4.0, min_span: float = 0.1, bins: int = 100, least: int = 8, k: int = 2, low: float = 0.2, high: float = 4.0, ridge: float = 1e-5, factor: float = 2.0, run: int = 4) -> DataFrame:
    """Dynamic harmonic regression, every observation with its ``predicted``
    value, ``bound`` (standard error ``S`` of the prediction), ``frequency`` and
    ``amplitude`` (arrays of ``k``), ``anomaly`` (valid and beyond ``factor *
    S``), ``streak`` (anomalies in a row) and ``change`` (the streak has reached
    ``run``).

    Frequencies are pursued one by one on the trailing ``window`` years, all
    windows of a series together. Invalid observations are predicted, too; they
    are never anomalies and end a streak. Without ``least`` valid observations
    over ``min_span`` years there is no prediction (nulls), and a streak stays.
    Null values are invalid. Of equal times none sees the others."""
    freqs = np.linspace(low, high, bins)

    def series(pdf: pd.DataFrame) -> pd.DataFrame:
        tt, yy = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        ok = pdf[valid].eq(True).to_numpy(bool) & np.isfinite(yy)
        got = _dynamic_fits(tt, yy, ok, freqs, window, min_span, least, k, ridge)
        at = got["at"]
        out = {t: tt, y: pdf[y].to_numpy()}
        for c in ("predicted", "bound", "frequency", "amplitude"):
            out[c] = column = np.full(len(tt), None, object)
            values = got[c].tolist()
            for i, v in zip(at.tolist(), values, strict=True):
                column[i] = v
        odd = np.zeros(len(tt), bool)
        odd[at] = ok[at] & (np.abs(yy[at] - got["predicted"]) > factor * got["bound"])
        out["anomaly"] = odd
        settles = ~ok.copy()
        settles[at] |= ~odd[at]
        count = np.cumsum(odd)
        out["streak"] = count - np.maximum.accumulate(np.where(settles, count, 0)) if len(tt) else count
        out["change"] = out["streak"] >= run
        return pd.DataFrame(out)

    schema = f"{t} double, {y} double, predicted double, bound double, frequency array<double>, amplitude array<double>, anomaly boolean, streak long, change boolean"
    return _per_series(df, keys, [t, y], series, schema)


def dynamic(df: DataFrame, keys: list[str], t: str, y: str, valid: str, window: float = 4.0, min_span: float = 0.1, bins: int = 100, least: int = 8, k: int = 2, low: float = 0.2, high: float = 4.0, ridge: float = 1e-5, factor: float = 2.0, run: int = 4, estimator: str = "omp") -> DataFrame:
    """Dynamic harmonic regression. For each observation: ``k`` frequencies of
    the trailing window by the chosen estimator, a ridge fit, a robust sigma
    and the prediction's standard error ``S``; anomaly beyond ``factor * S``.
    An invalid observation counts as normal and ends a streak."""
    freqs = np.linspace(low, high, bins)

    def frequencies(tt: np.ndarray, yy: np.ndarray) -> np.ndarray:
        z = yy - yy.mean()
        return kernels.distinct_peaks(freqs, kernels.sparse_spectrum(tt, z, freqs, "l1" if estimator == "bpdn" else "log", 200), k)

    def pursued(pdf: pd.DataFrame) -> dict:
        ok = pdf[valid].to_numpy(bool)
        tt, yy = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        got = _dynamic_fits(tt, yy, ok, freqs, window, min_span, least, k, ridge, estimator)
        scored = ok[got["at"]]
        at, bounds, tops = got["at"][scored], got["bound"][scored], np.round(1 / got["frequency"][scored, 0], 2)
        odd = np.abs(yy[at] - got["predicted"][scored]) > factor * bounds
        hits, first, flags = 0, None, dict(zip(at.tolist(), odd.tolist(), strict=True))
        for i in range(len(tt)):
            hits = 0 if not ok[i] or flags.get(i) is False else hits + int(flags.get(i, False))
            if hits == run and flags.get(i) and first is None:
                first = float(tt[i])
        values, counts = np.unique(tops, return_counts=True)
        return {"change_at": first, "anomalies": int(odd.sum()), "mean_bound": float(bounds.mean()) if len(at) else None, "period": float(values[np.argmax(counts)]) if len(at) else None, "scored": len(at)}

    def series(pdf: pd.DataFrame) -> dict:
        if estimator in ("omp", "nomp", "ndft"):
            return pursued(pdf)
        ok = pdf[valid].to_numpy(bool)
        tt, yy = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        hits, first, anomalies, bounds, tops = 0, None, 0, [], []
        begun = tt[ok][0] if ok.any() else np.inf
        for i in range(len(tt)):
            use = ok & (tt < tt[i]) & (tt >= tt[i] - window)
            if not ok[i]:
                hits = 0
                continue
            if tt[i] - begun < min_span or use.sum() < least or np.ptp(tt[use]) < min_span:
                continue
            wt, wy = tt[use] - tt[i], yy[use]
            f = frequencies(wt, wy)
            a = kernels.harmonics(wt, list(1 / f), linear=False)
            g = np.linalg.inv(a.T @ a + ridge * np.eye(a.shape[1]))
            coef = g @ a.T @ wy
            rest = wy - a @ coef
            sigma = max(1.4826 * np.median(np.abs(rest - np.median(rest))), 1e-6)
            x = kernels.harmonics(np.zeros(1), list(1 / f), linear=False)[0]
            s = sigma * np.sqrt(1 + x @ g @ x)
            bounds.append(s)
            tops.append(round(1 / f[0], 2))
            if abs(yy[i] - x @ coef) > factor * s:
                anomalies += 1
                hits += 1
                if hits == run and first is None:
                    first = float(tt[i])
            else:
                hits = 0
        values, counts = np.unique(tops, return_counts=True) if tops else ([None], [0])
        return {"change_at": first, "anomalies": anomalies, "mean_bound": float(np.mean(bounds)) if bounds else None, "period": None if values[0] is None else float(values[np.argmax(counts)]), "scored": len(bounds)}

    return _per_series(df, keys, [t], series, "change_at double, anomalies long, mean_bound double, period double, scored long")


def spectral_features(df: DataFrame, keys: list[str], t: str, y: str, valid: str, windows=(0.5, 1.0, 3.0), k: int = 2, least: int = 6, low: float = 0.2, high: float = 4.0, bins: int = 60) -> DataFrame:
    """For each observation and trailing window ``[b0, (cos, sin) * k, sigma]``,
    end to end; the token is valid if all its windows are."""
    freqs = np.linspace(low, high, bins)
    width = 2 + 2 * k

    def series(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[valid].to_numpy(bool)
        tt, yy = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        feats, good = np.zeros((len(tt), 0)), ok.copy()
        u, v = tt[ok], yy[ok]
        for w in windows:
            part = np.zeros((len(tt), width))
            lo, hi = np.searchsorted(u, tt - w, "left"), np.searchsorted(u, tt, "right")
            at = np.flatnonzero(hi - lo >= least)
            for block, first, last in moments.blocks(lo[at], hi[at]):
                rows = at[block]
                base = u[first:last] - u[first]
                fits = moments.Fits(base, v[first:last], lo[rows] - first, hi[rows] - first, freqs, k, 1e-5, centred=False)
                c, g = fits.coef, fits.gram
                # residuals' mean and square mean, and phases from the observation on
                mean = (fits.total - (g[:, 0] * c).sum(1)) / fits.n
                square = (fits.squares - 2 * (c * fits.right).sum(1) + np.einsum("ni,nij,nj->n", c, g, c)) / fits.n
                turn = 2 * np.pi * freqs[fits.picks] * (tt[rows] - u[first])[:, None]
                a, b = c[:, 1::2].copy(), c[:, 2::2].copy()
                c[:, 1::2], c[:, 2::2] = a * np.cos(turn) + b * np.sin(turn), b * np.cos(turn) - a * np.sin(turn)
                part[rows] = np.column_stack((c, np.sqrt(np.maximum(square - mean**2, 0))))
            good[hi - lo < least] = False
            feats = np.concatenate((feats, part), 1)
        feats = [f.tolist() for f in feats]
        return pd.DataFrame({t: tt, "features": feats, "ok": good})

    return _per_series(df, keys, [t], series, f"{t} double, features array<double>, ok boolean")


def pooled_frequencies(df: DataFrame, keys: list[str], t: str, y: str, estimator: str = "ndft", bins: int = 60, low: float = 0.2, high: float = 12.0, least: int = 10) -> DataFrame:
    """The dominant frequency of each series and its amplitude."""
    freqs = np.linspace(low, high, bins)

    def series(pdf: pd.DataFrame) -> dict:
        tt, yy = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        if len(tt) < least:
            return {"frequency": None, "amplitude": None}
        z = yy - yy.mean()
        if estimator == "nomp":
            f, coef = kernels.refined_pursuit(tt, z, freqs, 1)
            return {"frequency": float(f[0]), "amplitude": float(np.hypot(coef[1], coef[2]))}
        if estimator == "ndft":
            return strongest(kernels.spectrum(tt, z, freqs) * 2 / len(tt))
        return together([pdf])[0]

    def strongest(amp: np.ndarray) -> dict:
        return {"frequency": float(freqs[amp.argmax()]), "amplitude": float(amp.max())}

    def together(series: list[pd.DataFrame], few: int = 16) -> list[dict]:
        out = [{"frequency": None, "amplitude": None} for _ in series]
        long = [i for i, pdf in enumerate(series) if len(pdf) >= least]
        for k in range(0, len(long), few):
            some = long[k : k + few]
            times, values = ([series[i][c].to_numpy(float) for i in some] for c in (t, y))
            for i, amp in zip(some, kernels.sparse_spectra(times, values, freqs, "l1" if estimator == "bpdn" else "log", 300), strict=True):
                out[i] = strongest(amp)
        return out

    if estimator in ("bpdn", "cirl"):
        series.together = together
    return _per_series(df, keys, [t], series, "frequency double, amplitude double")
