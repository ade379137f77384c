"""Means, covariances and principal components of vectors of any group size.

Each task sums up what it reads, batch by batch, as count, mean and centred
products; these parts are combined pairwise in two steps, so no task sees a
group's rows. Scores then meet their model in shares of a group of at most
SHARE_ROWS rows.

Defined results: vectors that are null or hold a null, NaN or infinity don't
count and get a null score; vectors of unequal lengths raise; a null key is a
group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import with_group, written

#: Rows of a group that are scored together, and bytes of sums that a task holds.
SHARE_ROWS, HELD_BYTES = 50_000, 64 << 20
#: Parts of a group that are combined first.
SPREAD = 64

Sums = tuple[int, np.ndarray, np.ndarray]


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _sums(x: np.ndarray) -> Sums:
    mean = x.mean(0)
    c = x - mean
    return len(x), mean, c.T @ c


def _combined(a: Sums | None, b: Sums) -> Sums:
    if a is None:
        return b
    if len(a[1]) != len(b[1]):
        raise ValueError("vectors of a group have one length")
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def moments(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, n, mean, products`` (sums of products of deviations, row by row);
    one row a group."""
    rows = df.where(_usable(vector)).select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    kinds = "".join(f"`{k}` {t}, " for k, t in rows.select(*keys).dtypes)
    told = [*keys, "n", "mean", "products"]

    def batch(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        parts = [*(pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(keys)))]
        parts += [pa.array([s[0] for s in held.values()], pa.int64())]
        parts += [pa.array([s[j].ravel() for s in held.values()], pa.list_(pa.float64())) for j in (1, 2)]
        return pa.RecordBatch.from_arrays(parts, told)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = {}, None
        for b in batches:
            schema = b.schema
            lists = b.column(len(keys))
            sizes = np.diff(lists.offsets.to_numpy())
            if not len(sizes):
                continue
            if (sizes != sizes[0]).any():
                raise ValueError("vectors of a group have one length")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[c.to_pylist() for c in b.columns[: len(keys)]], strict=True) if keys else [()] * len(sizes)):
                at.setdefault(k, []).append(i)
            for k, i in at.items():
                held[k] = _combined(held.get(k), _sums(x[i]))
            if len(held) * x.shape[1] ** 2 * 8 > HELD_BYTES:
                yield batch(held, schema)
                held = {}
        if held:
            yield batch(held, schema)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, mean, products in zip(pdf["n"], pdf["mean"], pdf["products"], strict=True):
            total = _combined(total, (int(n), np.asarray(mean), np.asarray(products).reshape(len(mean), -1)))
        return pdf.iloc[:1][keys].assign(n=total[0], mean=[total[1]], products=[total[2].ravel()])

    schema = f"{kinds}n long, mean array<double>, products array<double>"
    parts = rows.mapInArrow(sums, schema)
    salt = F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("_salt")
    few = parts.groupBy(*keys, salt).applyInPandas(combine, schema)
    return few.groupBy(*keys).applyInPandas(combine, schema)


def scored(df: DataFrame, keys: list[str], id: str, vector: str, model: DataFrame, score: Callable[[np.ndarray, pd.Series], np.ndarray], out: str) -> DataFrame:
    """``keys, id`` and what ``score`` says of each vector by its group's row of
    ``model`` (which has ``n``). A group is dealt out by ``id`` in shares."""
    model = written(model)
    shares = F.ceil(F.col("n") / SHARE_ROWS).cast("int")
    counted = with_group(df.select(*keys, id, F.when(_usable(vector), F.col(vector).cast("array<double>")).alias("_v")), model.select(*keys, shares.alias("_shares")), keys)
    rows = counted.withColumn("_salt", F.pmod(F.xxhash64(id), F.col("_shares")).cast("int"))
    each = model.withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    kinds = dict(df.dtypes)

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        res = left[[*keys, id]].copy()
        res[out] = np.nan
        ok = left["_v"].notna().to_numpy()
        if ok.any() and len(right):
            values = score(np.stack(left["_v"][ok].to_list()), right.iloc[0])
            res.loc[ok, out] = np.nan if values is None else values
        return res

    schema = "".join(f"`{k}` {kinds[k]}, " for k in dict.fromkeys([*keys, id])) + f"{out} double"
    got = rows.groupBy(*keys, "_salt").cogroup(each.groupBy(*keys, "_salt")).applyInPandas(judge, schema)
    got = got.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))
    # groups without a usable vector have no model
    none = df.select(*keys, id).join(model.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(1).alias("_has")), _same(df, keys), "left_anti") if keys else df.select(id).where(F.lit(model.isEmpty()))
    return got.unionByName(none.withColumn(out, F.lit(None).cast("double")))


def _same(df: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & df[k].eqNullSafe(F.col(f"_k_{k}"))
    return out


def mahalanobis(df: DataFrame, keys: list[str], id: str, vector: str, ridge: float = 1e-5) -> DataFrame:
    """Distance of each vector to its key's mean over the square root of the
    dimension; null for keys with fewer than dimension + 2 vectors."""

    def distance(x: np.ndarray, model: pd.Series) -> np.ndarray | None:
        mean, n = np.asarray(model["mean"]), int(model["n"])
        d = len(mean)
        if n < d + 2:
            return None
        inverse = np.linalg.inv(np.asarray(model["products"]).reshape(d, d) / (n - 1) + ridge * np.eye(d))
        c = x - mean
        return np.sqrt(np.einsum("ni,ij,nj->n", c, inverse, c) / d)

    return scored(df, keys, id, vector, moments(df, keys, vector), distance, "distance")


def reconstruction_error(df: DataFrame, keys: list[str], id: str, vector: str, k: int) -> DataFrame:
    """Mean square of what the first ``k`` principal components of a key leave
    of each vector: high where a vector is unlike the others."""

    def error(x: np.ndarray, model: pd.Series) -> np.ndarray:
        mean = np.asarray(model["mean"])
        _, vectors = np.linalg.eigh(np.asarray(model["products"]).reshape(len(mean), -1))
        c = x - mean
        kept = c @ vectors[:, ::-1][:, :k]
        return np.maximum((c * c).sum(1) - (kept * kept).sum(1), 0) / len(mean)

    return scored(df, keys, id, vector, moments(df, keys, vector), error, "error")
