"""Detectors on scored series."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels, series, stats


def reconstruction(df: DataFrame, keys: list[str], order: str, residual: Column, valid: Column, factor: float = 3.0, run: int = 3) -> DataFrame:
    """Per key: first streak of ``run`` residuals beyond ``factor`` robust
    sigmas; an invalid row ends a streak."""
    rows = df.withColumn("_r", F.when(valid, residual)).withColumn("_ok", valid)
    sigma = stats.mad_sigma(rows.where(F.col("_r").isNotNull()), keys, "_r")
    flagged = rows.join(sigma, keys)
    runs = series.streaks(flagged, keys, [order], F.abs("_r") > factor * F.col("sigma"), F.col("_ok"), "reset")
    return series.first_change(runs, keys, order, run)


def cusum(df: DataFrame, keys: list[str], order: list[str], distance: str, slack: float = 0.5, out: str = "cusum") -> DataFrame:
    """``S = max(0, S + d - median - slack)`` in closed form: the running sum
    less its lowest value so far. Null distances leave the sum as it is."""
    middle = df.groupBy(*keys).agg(F.percentile(distance, F.lit(0.5)).alias("_ref"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.join(middle, keys).withColumn("_c", F.sum(F.coalesce(F.col(distance) - F.col("_ref") - slack, F.lit(0.0))).over(w))
    return rows.withColumn(out, F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w))).drop("_ref", "_c")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def reference_drift(df: DataFrame, keys: list[str], order: str, vector: str, first: int = 3) -> DataFrame:
    """Adds ``drift``: one less the cosine to the mean of the key's first
    ``first`` vectors."""
    w = Window.partitionBy(*keys).orderBy(order)
    early = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    parts = early.select(*keys, F.posexplode(vector).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    mean = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_ref"))
    return df.join(mean, keys).withColumn("drift", 1 - cosine(F.col(vector), F.col("_ref"))).drop("_ref")


def bound_anomaly(actual: Column, predicted: Column, epistemic: Column, aleatoric: Column, factor: float) -> Column:
    """Beyond ``factor`` joint deviations; 255 without a prediction."""
    beyond = F.abs(predicted - actual) > factor * F.sqrt(epistemic * epistemic + aleatoric * aleatoric)
    return F.when(predicted.isNull(), F.lit(255)).otherwise(beyond.cast("int"))


@dataclass
class Drift:
    """An exponential baseline of scores and its verdicts.

    ``status``: 0 normal, 1 warning, 2 drift, 3 warm-up. Thresholds come from
    the state before the observation; only normal and warm-up observations
    move the baseline; after a drift it starts anew with deviation 1.
    """

    alpha: float = 0.05
    warm: int = 20
    warning: float = 2.0
    drift: float = 3.0
    run: int = 3

    START = (0.0, 1e-5, 0, 0)

    def step(self, state: tuple, score: float, valid: bool) -> tuple[tuple, int]:
        mean, std, counter, steps = state
        warming = steps < self.warm
        far = score > mean + self.drift * std
        warn = score > mean + self.warning * std and not far
        calm = score <= mean + self.warning * std
        if valid:
            counter = counter + 1 if far and not warming else 0
        status = 1 if warn else 0
        if far and counter >= self.run:
            status = 2
        if warming:
            status = 3
        if not valid:
            status = 0
        if valid and (calm or warming):
            gap = score - mean
            mean, std = mean + self.alpha * gap, ((1 - self.alpha) * std**2 + self.alpha * gap**2) ** 0.5
        state = (mean, std, counter, steps + int(valid))
        return ((0.0, 1.0, 0, 0) if status == 2 else state), status

    def steps(self, score: np.ndarray, valid: np.ndarray, first: np.ndarray, start: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Statuses of series that lie end to end, the k-th from ``first[k]``
        on, by the rules of ``step``; the first one goes on from ``start``.
        Also the state after the last row.

        Series are sorted by length and stepped together as long as several
        are left; the rest of the longest ones go row by row. Memory is that of
        the rows, whatever their lengths."""
        out = np.zeros(len(score), np.int32)
        length = np.diff(np.append(first, len(score)))
        order = np.argsort(-length, kind="stable")
        begin, long = first[order], length[order]
        n = len(first)
        mean, std = np.full(n, self.START[0]), np.full(n, self.START[1])
        counter, seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if start is not None:
            at = int(np.flatnonzero(order == 0)[0])
            mean[at], std[at], counter[at], seen[at] = start
        k, active = 0, int((long > 0).sum())
        while active >= FEW_SERIES:
            rows = begin[:active] + k
            s, v, m, d, c, w = score[rows], valid[rows], mean[:active], std[:active], counter[:active], seen[:active]
            warming = w < self.warm
            far = s > m + self.drift * d
            calm = s <= m + self.warning * d
            c = np.where(v, np.where(far & ~warming, c + 1, 0), c)
            status = np.where(far & (c >= self.run), 2, np.where(~far & ~calm, 1, 0))
            status = np.where(v, np.where(warming, 3, status), 0)
            moved = v & (calm | warming)
            gap = np.where(moved, s - m, 0.0)
            d = np.where(moved, np.sqrt((1 - self.alpha) * d**2 + self.alpha * gap**2), d)
            anew = status == 2
            mean[:active], std[:active] = np.where(anew, 0.0, m + self.alpha * gap), np.where(anew, 1.0, d)
            counter[:active], seen[:active] = np.where(anew, 0, c), np.where(anew, 0, w + v)
            out[rows] = status
            k += 1
            active = int(np.searchsorted(-long[:active], -k, "left"))
        for j in range(active):
            lo, hi = int(begin[j]) + k, int(begin[j] + long[j])
            state = (float(mean[j]), float(std[j]), int(counter[j]), int(seen[j]))
            for i, (x, ok) in enumerate(zip(score[lo:hi].tolist(), valid[lo:hi].tolist(), strict=True), lo):
                state, out[i] = self.step(state, x, ok)
            mean[j], std[j], counter[j], seen[j] = state
        last = int(np.flatnonzero(order == n - 1)[0])
        return out, (float(mean[last]), float(std[last]), int(counter[last]), int(seen[last]))


#: With fewer series left, each is stepped by itself.
FEW_SERIES = 8
#: Rows whose series are stepped together.
STEP_ROWS = 50_000


def drift_statuses(df: DataFrame, keys: list[str], order: list[str], score: str, valid: str, detector: Drift | None = None, step_rows: int = STEP_ROWS) -> DataFrame:
    """Batch form: every row of a key, in order, with its ``status``. A task
    holds about ``step_rows`` rows; a longer key goes on from its state."""
    detector = detector or Drift()
    names = [*keys, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, before, state = [], 0, None, None

        def judged() -> Iterator[pa.RecordBatch]:
            nonlocal before, state
            table = pa.Table.from_batches(held).combine_chunks()
            changed = np.zeros(len(table), bool)
            for k in keys:
                codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
                codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
            first = np.concatenate(([0], np.flatnonzero(changed)))
            ok = np.nan_to_num(table[valid].to_numpy(zero_copy_only=False).astype(float)) > 0
            s = np.where(ok, np.nan_to_num(table[score].to_numpy(zero_copy_only=False).astype(float)), 0.0)
            # the key that the rows before ended with goes on from its state
            goes_on = before is not None and before == [table[k][0] for k in keys]
            statuses, state = detector.steps(s, ok, first, state if goes_on else None)
            before = [table[k][-1] for k in keys]
            yield from table.select(names).append_column("status", pa.array(statuses, pa.int32())).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= step_rows:
                yield from judged()
                held, count = [], 0
        if count:
            yield from judged()

    rows = df.select(*names, score, valid)
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("status", T.IntegerType())])
    return rows.repartition(*keys).sortWithinPartitions(*names).mapInArrow(run, schema)


def frame_shifts(df: DataFrame, frame: str, value: str, height: int, width: int, upsample: int = 10) -> DataFrame:
    """Shift of each frame against the one before, by phase correlation: each
    task gets the two frames of a pair."""
    nxt = df.select((F.col(frame) + 1).alias("pair"), F.lit(0).alias("side"), "y", "x", value)
    own = df.select(F.col(frame).alias("pair"), F.lit(1).alias("side"), "y", "x", value)

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == s] for s in (0, 1)]
        if not (len(sides[0]) and len(sides[1])):
            return pd.DataFrame({"pair": [], "dy": [], "dx": []})
        images = []
        for part in sides:
            image = np.zeros((height, width))
            image[part["y"], part["x"]] = part[value]
            images.append(image - image.mean())
        dy, dx = kernels.phase_shift(*images, upsample)
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "dy": [dy], "dx": [dx]})

    return nxt.unionByName(own).groupBy("pair").applyInPandas(shift, "pair long, dy double, dx double")
