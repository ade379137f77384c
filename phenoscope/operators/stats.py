"""Robust and descriptive statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Median absolute deviation to standard deviation of a normal variable.
MAD_SCALE = 1.4826


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin`` (from 1), ``n`` and ``density``; the last bin holds its right
    edge, and what lies outside is left out."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    place = F.least(F.floor((F.col(value) - low) / width) + 1, F.lit(bins)).cast("int")
    counts = inside.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) * width))


#: Split points of a range that a histogram of equal widths doesn't narrow.
SPLITS = 64


def exact_quantiles(df: DataFrame, value: str, shares: list[float], bins: int = 4096, keep: int = 20_000) -> list[float | None]:
    """Quantiles with linear interpolation, as ``percentile`` gives them, of all
    non-null values: -inf comes first, then numbers, inf and NaN. Histograms
    narrow the range of each rank down to at most ``keep`` values (or equal
    ones), ten times that for all ranks, which the driver reads in one pass and
    sorts: no task gathers the distinct values. Where
    bins of equal width leave most values in one of them, the next round splits
    that range at approximate quantiles instead, so values of any spread end in
    a few rounds."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    endless = F.lit(float("inf"))
    numbers = rows.where(~F.isnan("v") & (F.abs("v") < endless))
    least, most, odd = (F.coalesce(F.sum(c.cast("long")), F.lit(0)) for c in (F.col("v") == -endless, F.col("v") == endless, F.isnan("v")))
    n, under, over, nans = rows.agg(F.count("*"), least, most, odd).first()
    if not n:
        return [None] * len(shares)
    ranks = sorted({f(s * (n - 1)) for s in shares for f in (math.floor, math.ceil)})
    found: dict[int, float] = {r: -math.inf for r in ranks if r < under}
    found |= {r: math.inf if r < n - nans else math.nan for r in ranks if r >= n - nans - over}
    inside = [r for r in ranks if r not in found]
    # value range, values before it, values in it, ranks, whether to split at quantiles
    todo = [(*numbers.agg(F.min("v"), F.max("v")).first(), under, n - under - over - nans, inside, False)] if inside else []
    root = todo[0][:2] if todo else ()
    while todo:
        found |= {r: t[0] for t in todo if t[0] == t[1] for r in t[4]}
        todo = [t for t in todo if t[0] != t[1]]
        # the driver sorts what is left of all ranges at once
        room = max(1, min(keep, 10 * keep // max(1, len(todo))))
        small, wide = [t for t in todo if t[3] <= room], [t for t in todo if t[3] > room]
        if small:
            values: dict[int, list[float]] = {}
            for i, v in _placed(numbers, root, small, bins).select("i", "v").collect():
                values.setdefault(i, []).append(v)
            for i, (_, _, before, _, wanted, _) in enumerate(small):
                values[i].sort()
                found |= {r: values[i][r - before] for r in wanted}
        todo = []
        if wide:
            # one pass for all ranges that are still wide
            at = _placed(numbers, root, wide, bins, _splits(numbers, root, wide, bins))
            # halves keep the width of the widest range finite
            even = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins
            place = F.when(F.size("cuts") > 0, F.size(F.filter("cuts", lambda c: c <= F.col("v")))).otherwise(F.least(F.floor(even), F.lit(bins - 1)))
            cells = at.groupBy("i", place.alias("b")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy("i", "b").collect()
            of: dict[int, list] = {}
            for c in cells:
                of.setdefault(c["i"], []).append(c)
            for i, (_, _, before, count, wanted, _) in enumerate(wide):
                upto = before
                for c in of[i]:
                    here = [r for r in wanted if upto <= r < upto + c["m"]]
                    if here:
                        todo.append((c["a"], c["z"], upto, c["m"], here, 2 * c["m"] > count))
                    upto += c["m"]
    out = []
    for s in shares:
        at = s * (n - 1)
        lo, hi = found[math.floor(at)], found[math.ceil(at)]
        out.append(lo if lo == hi or math.floor(at) == at else lo * (math.ceil(at) - at) + hi * (at - math.floor(at)))
    return out


def _placed(numbers: DataFrame, root: tuple[float, float], spans: list[tuple], bins: int, cuts: dict[int, list[float]] | None = None) -> DataFrame:
    """The values that lie in one of the ranges, with its number ``i``, ends and
    ``cuts``: met by bins of the whole range, as each falls in few of them."""
    low, high = root
    of = lambda c: F.least(F.floor((F.col(c) / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1))
    rows = [(i, t[0], t[1], (cuts or {}).get(i, [])) for i, t in enumerate(spans)]
    ranges = numbers.sparkSession.createDataFrame(rows, "i int, lo double, hi double, cuts array<double>")
    if len(spans) > 1:  # at most two ranges a share
        met = ranges.withColumn("cell", F.explode(F.sequence(of("lo"), of("hi"))))
        return numbers.withColumn("cell", of("v")).join(F.broadcast(met), "cell").where(F.col("v").between(F.col("lo"), F.col("hi")))
    return numbers.join(F.broadcast(ranges)).where(F.col("v").between(*spans[0][:2]))


def _splits(numbers: DataFrame, root: tuple[float, float], spans: list[tuple], bins: int) -> dict[int, list[float]]:
    """Approximate quantiles of the ranges that are to be split at them; a
    range's own ends part from what lies between."""
    some = [(i, t) for i, t in enumerate(spans) if t[-1]]
    if not some:
        return {}
    shares = [k / SPLITS for k in range(1, SPLITS)]
    found = _placed(numbers, root, [t for _, t in some], bins).groupBy("i").agg(F.percentile_approx("v", shares, 100 * SPLITS).alias("q")).collect()
    return {some[r["i"]][0]: sorted({*r["q"], some[r["i"]][1][1]} - {some[r["i"]][1][0]}) for r in found}


def scale_factor(df: DataFrame, keys: list[str], x: str, y: str, digits: int) -> DataFrame:
    ratio = F.col(y) / F.nullif(F.col(x), F.lit(0.0))
    xy, xx = F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))
    return df.groupBy(*keys).agg(F.round(xy / xx, digits).alias("scale"), F.round(F.percentile(ratio, F.lit(0.5)), digits).alias("med_ratio"), F.round(F.avg(ratio), digits).alias("mean_ratio"))


def quantile_pairs(a: DataFrame, b: DataFrame, value: str, digits: int) -> DataFrame:
    """Percentiles 1 to 99 of two samples side by side."""
    shares = [i / 100 for i in range(1, 100)]
    rows = [(i + 1, x, y) for i, (x, y) in enumerate(zip(exact_quantiles(a, value, shares), exact_quantiles(b, value, shares)))]
    both = a.sparkSession.createDataFrame(rows, "p int, qa double, qb double")
    return both.select("p", F.round("qa", digits).alias("qa"), F.round("qb", digits).alias("qb"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each key, the smallest of equals."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("m"))
    return best.select(*keys, F.col("m.v").alias("mode"), (-F.col("m.k")).alias("n"))


def difference_report(df: DataFrame, keys: list[str], a: str, b: str, digits: int) -> DataFrame:
    rel = F.when(F.col(b) > 0, F.abs(F.col(a) - F.col(b)) / F.col(b))
    r = lambda c, n: F.round(c, digits).alias(n)
    return df.groupBy(*keys).agg(
        r(F.max(rel), "mx"), r(F.avg(rel), "mean"), r(F.percentile(rel, F.lit(0.5)), "med"), r(F.percentile(rel, F.lit(0.95)), "p95"), r(F.percentile(rel, F.lit(0.99)), "p99"),
        F.count_if(F.col(a) == F.col(b)).alias("exact"),
    )


def contamination(df: DataFrame, value: str, share: float) -> DataFrame:
    """Flags what lies above the percentile that leaves ``share``."""
    limit = exact_quantiles(df, value, [1 - share])[0]
    return df.withColumn("flag", F.col(value) > F.lit(limit).cast("double"))


def mad_sigma(df: DataFrame, keys: list[str], value: str, floor: float = 1e-6) -> DataFrame:
    """Robust standard deviation of each key."""
    middle = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    gap = F.abs(F.col(value) - F.col("_m"))
    return df.join(middle, keys).groupBy(*keys).agg(F.greatest(MAD_SCALE * F.percentile(gap, F.lit(0.5)), F.lit(floor)).alias("sigma"))


def kernel_density(df: DataFrame, keys: list[str], value: str, low: float, high: float, points: int) -> DataFrame:
    """Gaussian density on a grid, with bandwidth ``sd * n ** (-1/5)``. The
    rows of a key are first counted on a fine mesh, so the sum over them is
    bounded whatever their number."""
    mesh = 4096
    step = (high - low) / mesh
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"))
    cells = df.groupBy(*keys, F.floor((F.col(value) - low) / step).alias("c")).agg(F.count(value).alias("m"), F.avg(value).alias("v"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * ((high - low) / (points - 1))))
    h = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    rows = cells.join(stats, keys).select(*keys, "m", "v", "n", h.alias("h"), grid.alias("at"))
    z = (F.col("at") - F.col("v")) / F.col("h")
    return rows.groupBy(*keys, "at").agg((F.sum(F.col("m") * F.exp(-z * z / 2)) / F.first(F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def simplex_volumes(spark: SparkSession, trials: int, points: int, bands: int, seed: int) -> DataFrame:
    """Largest parallelotope volume found by random spectra, for each number of
    vectors. Every trial is seeded by its own number."""
    from .kernels import volume_curve

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([np.random.default_rng((seed, int(t))).random((points, bands)) for t in pdf["id"]])
            curve = volume_curve(x - x.mean(1, keepdims=True))
            yield pd.DataFrame({"vectors": np.tile(np.arange(1, points + 1), len(x)), "volume": curve.ravel()})

    return spark.range(trials).mapInPandas(run, "vectors int, volume double").groupBy("vectors").agg(F.max("volume").alias("volume"), F.count("*").alias("trials"))


def discrete_bound(spark: SparkSession, total: int) -> DataFrame:
    a = spark.range(total + 1).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(total) - F.col("id"))).alias("b"))
    c = total - F.col("a") - F.col("b")
    return a.agg((F.max(F.pow(F.col("a") + F.col("b"), F.lit(2)) * (F.col("a") + 4 * F.col("b") + 3 * c)) / float(total) ** 3).alias("squared"))
