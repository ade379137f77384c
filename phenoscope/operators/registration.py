"""Rigid registration of consecutive frames under their masks.

Pixels travel in tiles, one row each, and are grouped once. For each pair of
frames one window is chosen, clear in both and of the largest contrast, by sums
over blocks; only its tiles go to the task that registers the pair. There a correlation under both masks gives whole pixels, and a simplex
search shifts and turns the moving image until it correlates best with the
reference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import written

#: Least share of a window that must be valid in both frames to compare them.
OVERLAP = 0.15
#: Pixels a side of a tile.
TILE = 16


def masked_shift(a: np.ndarray, b: np.ndarray, ok_a: np.ndarray, ok_b: np.ndarray, overlap: float = 0.3) -> tuple[int, int]:
    """Rows and columns to move ``b`` by so that it correlates best with ``a``
    where both are valid; shifts that share less than ``overlap`` of the most
    that any shift shares don't count (normalised correlation under masks by
    Fourier transforms)."""
    shape = [n + m - 1 for n, m in zip(a.shape, b.shape, strict=True)]
    fast = [1 << (n - 1).bit_length() for n in shape]
    there = lambda x: np.fft.rfft2(x, fast)
    back = lambda f: np.fft.irfft2(f, fast)[: shape[0], : shape[1]]
    a, b = np.where(ok_a, a - a[ok_a].mean(), 0.0), np.where(ok_b, b - b[ok_b].mean(), 0.0)
    b, ok_b = b[::-1, ::-1], ok_b[::-1, ::-1]
    fa, fb, ma, mb = there(a), there(b), there(ok_a.astype(float)), there(ok_b.astype(float))
    shared = np.maximum(np.round(back(ma * mb)), 1e-9)
    sum_a, sum_b = back(fa * mb), back(ma * fb)
    var_a = np.maximum(back(there(a * a) * mb) - sum_a**2 / shared, 0)
    var_b = np.maximum(back(ma * there(b * b)) - sum_b**2 / shared, 0)
    spread = np.sqrt(var_a * var_b)
    r = np.where(spread > 1e-9 * max(spread.max(), 1e-30), (back(fa * fb) - sum_a * sum_b / shared) / np.maximum(spread, 1e-30), 0.0)
    r[shared < overlap * shared.max()] = -np.inf
    i, j = np.unravel_index(r.argmax(), r.shape)
    return int(i) - b.shape[0] + 1, int(j) - b.shape[1] + 1


#: The four neighbours at ``-1, 0, 1, 2`` give the powers of cubic convolution.
_CUBIC = np.array([[0, 1, 0, 0], [-0.5, 0, 0.5, 0], [1, -2.5, 2, -0.5], [-0.5, 1.5, -1.5, 0.5]])


class Mover:
    """``image`` turned about its middle and then moved, sampled by cubic
    convolution, and where the result is valid: all sixteen neighbours lie
    inside and are, so nothing of a cloud is mixed in. Only pixels in ``wanted``
    are sampled; what no motion changes is worked out once."""

    def __init__(self, image: np.ndarray, ok: np.ndarray, wanted: np.ndarray):
        h, w = self.shape = image.shape
        y, x = np.nonzero(wanted)
        self.y, self.x = y - float(h // 2), x - float(w // 2)
        # between a pixel's neighbours the image is a polynomial of both ways
        across = [sum(m * image[:, j : w - 3 + j] for j, m in enumerate(row)) for row in _CUBIC]
        self.powers = [[sum(m * c[i : h - 3 + i] for i, m in enumerate(row)).ravel() for c in across] for row in _CUBIC]
        self.clear = np.logical_and.reduce([ok[i : h - 3 + i, j : w - 3 + j] for i in range(4) for j in range(4)]).ravel()

    def __call__(self, dy: float, dx: float, degrees: float) -> tuple[np.ndarray, np.ndarray]:
        """Samples of the valid pixels and their places among those wanted."""
        h, w = self.shape
        sin, cos = np.sin(np.deg2rad(degrees)), np.cos(np.deg2rad(degrees))
        sy = cos * self.y - sin * self.x + (h // 2 + sin * dx - cos * dy)
        sx = sin * self.y + cos * self.x + (w // 2 - cos * dx - sin * dy)
        fy, fx = np.floor(sy), np.floor(sx)
        at = (fy * (w - 3) + (fx - (w - 2))).astype(np.int64)
        inside = (fy >= 1) & (fy < h - 2) & (fx >= 1) & (fx < w - 2)
        valid = np.flatnonzero(inside & self.clear.take(at, mode="clip"))
        at, ty, tx = at.take(valid), (sy - fy).take(valid), (sx - fx).take(valid)
        out = np.zeros(len(at))
        for row in reversed(self.powers):
            out *= ty
            part = row[3].take(at)
            for c in row[2::-1]:
                part *= tx
                part += c.take(at)
            out += part
        return out, valid


def moved(image: np.ndarray, ok: np.ndarray, dy: float, dx: float, degrees: float) -> tuple[np.ndarray, np.ndarray]:
    """All of what a ``Mover`` gives (0 where it is not valid), and where it is."""
    samples, at = Mover(image, ok, np.ones(image.shape, bool))(dy, dx, degrees)
    out, valid = np.zeros(image.shape), np.zeros(image.shape, bool)
    out.flat[at], valid.flat[at] = samples, True
    return out, valid


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray, x_tol: float = 1e-4, f_tol: float = 1e-4, most: int = 600) -> tuple[np.ndarray, float]:
    """Least value of ``f`` inside bounds by a simplex search: reflect, expand,
    contract, shrink; points beyond a bound are put on it."""
    clip = lambda p: np.clip(p, low, high)
    points = [clip(start)] + [clip(start + step * (np.arange(len(start)) == k)) for k in range(len(start))]
    values, tried = [f(p) for p in points], len(points)
    while tried < most:
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) <= x_tol and values[-1] - values[0] <= f_tol:
            break
        middle = np.mean(points[:-1], axis=0)
        out = clip(2 * middle - points[-1])
        at = f(out)
        tried += 1
        if at < values[0]:
            far = clip(3 * middle - 2 * points[-1])
            beyond = f(far)
            tried += 1
            points[-1], values[-1] = (far, beyond) if beyond < at else (out, at)
        elif at < values[-2]:
            points[-1], values[-1] = out, at
        else:
            near = clip(middle + 0.5 * ((out if at < values[-1] else points[-1]) - middle))
            inner = f(near)
            tried += 1
            if inner < min(at, values[-1]):
                points[-1], values[-1] = near, inner
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                tried += len(points) - 1
    best = int(np.argmin(values))
    return points[best], float(values[best])


def rigid_fit(a: np.ndarray, b: np.ndarray, ok_a: np.ndarray, ok_b: np.ndarray, reach: float = 2.0, turn: float = 2.0) -> tuple[float, float, float, float]:
    """``dy, dx, degrees, r``: how to move ``b`` onto ``a``, within ``reach``
    pixels of the whole-pixel shift and ``turn`` degrees."""
    dy, dx = masked_shift(a, b, ok_a, ok_b)
    least = OVERLAP * a.size
    move, fixed = Mover(np.where(ok_b, b, b[ok_b].mean()), ok_b, ok_a), a[ok_a]

    def apart(p: np.ndarray) -> float:
        image, at = move(*p)
        if len(image) < least:
            return 1.0
        there = fixed.take(at)
        u, v = there - there.mean(), image - image.mean()
        return -float(u @ v / max(np.sqrt((u @ u) * (v @ v)), 1e-30))

    start = np.array([dy, dx, 0.0])
    size = np.array([reach, reach, turn])
    p, value = simplex(apart, start, np.array([0.5, 0.5, 0.5]), start - size, start + size)
    return float(p[0]), float(p[1]), float(p[2]), -value


def tile_array(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of ``TILE`` squared pixels as an Arrow column: null where there is
    no pixel."""
    flat = pa.array(values.ravel(), mask=~there.ravel())
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, TILE * TILE, dtype=np.int32), flat)


def tile_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of tiles (NaN where not valid), and where there is a pixel; null
    tiles have none."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values, there = np.full((len(column), TILE * TILE), np.nan), np.zeros((len(column), TILE * TILE), bool)
    values[known] = flat.to_numpy(zero_copy_only=False).reshape(-1, TILE * TILE)
    there[known] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, TILE * TILE)
    return values, there


def tiled(df: DataFrame, keys: list[str], frame: str, value: str, valid: str) -> DataFrame:
    """Pixels as tiles: ``keys, frame, ty, tx, v``, an array of ``TILE`` squared
    doubles by row and column, null where there is no pixel, NaN where it is not
    valid."""
    ok = F.coalesce(F.col(valid), F.lit(False)) & F.col(value).isNotNull() & ~F.isnan(value)
    at = (F.pmod("y", F.lit(TILE)) * TILE + F.pmod("x", F.lit(TILE))).cast("int").alias("at")
    v = F.when(ok, F.col(value).cast("double")).otherwise(float("nan")).alias("v")
    place = [F.floor(F.col(c) / TILE).cast("int").alias(f"t{c}") for c in "yx"]
    rows = df.where("y is not null and x is not null").select(*keys, F.col(frame).alias("frame"), *place, F.struct(at, v).alias("p"))
    told = [*keys, "frame", "ty", "tx"]
    schema = T.StructType([*rows.select(told).schema.fields, T.StructField("v", T.ArrayType(T.DoubleType()))])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed, n = b.column("p"), b.num_rows
            at, v = listed.flatten().flatten()
            where = np.repeat(np.arange(n), listed.value_lengths().to_numpy()), at.to_numpy()
            values, there = np.full((n, TILE * TILE), np.nan), np.zeros((n, TILE * TILE), bool)
            np.fmax.at(values, where, v.to_numpy(zero_copy_only=False))  # a pixel may come twice
            there[where] = True
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in told], tile_array(values, there)], names=schema.names)

    return rows.groupBy(*told).agg(F.collect_list("p").alias("p")).mapInArrow(dense, schema)


def pixels(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles as pixels: ``keys, frame, y, x, v`` and whether it is valid (``ok``)."""
    rows = tiles.select(*keys, "frame", "ty", "tx", F.posexplode("v").alias("at", "v")).where("v is not null")
    place = [(F.col("ty") * TILE + F.floor(F.col("at") / TILE)).cast("int").alias("y"), (F.col("tx") * TILE + F.col("at") % TILE).cast("int").alias("x")]
    return rows.select(*keys, "frame", *place, "v", (~F.isnan("v")).alias("ok"))


def tile_pairs(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each tile of each two consecutive frames of a key: ``a, b``,
    null where a frame has no such tile."""
    tiles = written(tiles)
    order, told = Window.partitionBy(*keys).orderBy("a_frame"), [*keys, "a_frame", "b_frame"]
    frames = written(tiles.select(*keys, F.col("frame").alias("a_frame")).distinct().withColumn("b_frame", F.lead("a_frame").over(order)).where("b_frame is not null"))
    side = lambda c: tiles.withColumnRenamed("frame", f"{c}_frame").join(frames, [*keys, f"{c}_frame"]).select(*told, "ty", "tx", F.col("v").alias(c))
    # compressed tiles may look small, but none are to be broadcast
    return side("a").join(side("b").hint("merge"), [*told, "ty", "tx"], "full")


def frame_pairs(df: DataFrame, keys: list[str], frame: str, value: str, valid: str) -> DataFrame:
    """``tile_pairs`` of pixels."""
    return tile_pairs(tiled(df, keys, frame, value, valid), keys)


def clearest_windows(pairs: DataFrame, keys: list[str], span: int, clear: float = 0.65) -> DataFrame:
    """For each pair of frames the window (``y0, x0``) of ``span`` pixels a side
    with the largest share valid in both, then of the largest variance of the
    reference; none below ``clear``. Windows start every quarter of ``span``;
    block sums are added up to windows, so tiles are read once."""
    step, told = span // 4, [*keys, "a_frame", "b_frame"]
    if span % 4:
        raise ValueError("span must be a multiple of four")
    counts = {"by": T.LongType(), "bx": T.LongType(), "n": T.LongType(), "s": T.DoubleType(), "q": T.DoubleType(), "seen": T.LongType()}
    schema = T.StructType([*pairs.select(told).schema.fields, *[T.StructField(c, t) for c, t in counts.items()]])
    reach = (TILE - 1) // step + 2  # blocks a side that a tile may touch

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, in_a), (b, in_b) = (tile_values(batch.column(c)) for c in "ab")
            first, at = {}, np.zeros((batch.num_rows, TILE, TILE), np.int64)
            for c, shape in (("ty", (-1, TILE, 1)), ("tx", (-1, 1, TILE))):
                low = batch.column(c).to_numpy().astype(np.int64)[:, None] * TILE
                first[c] = low[:, 0] // step
                at = at * reach + ((low + np.arange(TILE)) // step - first[c][:, None]).reshape(shape)
            at = (np.arange(batch.num_rows)[:, None] * reach * reach + at.reshape(-1, TILE * TILE)).ravel()
            use = ~(np.isnan(a) | np.isnan(b))
            v = np.where(use, a, 0.0)
            n, s, q, seen = (np.bincount(at, x.ravel(), batch.num_rows * reach * reach) for x in (use, v, v * v, in_a | in_b))
            found = np.flatnonzero(seen)
            row, by, bx = found // (reach * reach), found // reach % reach, found % reach
            columns = [first["ty"][row] + by, first["tx"][row] + bx, n[found].astype(np.int64), s[found], q[found], seen[found].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in told] + [pa.array(c) for c in columns], names=schema.names)

    blocks = pairs.mapInArrow(sums, schema)
    start = lambda c: F.explode(F.sequence(F.col(c) - 3, F.col(c)))
    spread = blocks.withColumn("wy", start("by")).withColumn("wx", start("bx")).where("wy >= 0 and wx >= 0")
    whole = spread.groupBy(*told, "wy", "wx").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "seen")])
    full = whole.where((F.col("seen") == span * span) & (F.col("n") >= clear * span * span))  # wholly inside
    contrast = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    best = full.groupBy(*told).agg(F.max(F.struct(F.col("n"), F.round(contrast, 12).alias("c"), (-F.col("wy")).alias("y"), (-F.col("wx")).alias("x"))).alias("w"))
    return best.select(*told, (-F.col("w.y") * step).alias("y0"), (-F.col("w.x") * step).alias("x0"), (F.col("w.n") / (span * span)).alias("clear"))


def register_frames(df: DataFrame, keys: list[str], frame: str, value: str, valid: str, span: int = 100, pixel: tuple[float, float] = (30.0, 30.0), limit: float = 250.0) -> DataFrame:
    """For each two consecutive frames of a key how the later one must be moved
    (``dy``, ``dx`` pixels, then ``degrees`` about the window's middle) to lie
    on the earlier one: ``a_frame, b_frame, y0, x0, clear, dy, dx, degrees, r,
    offset`` (in units of ``pixel``, its height and width) and ``verdict``:
    ``ok``, ``no overlap`` or, for an offset above ``limit``, ``too far``.

    A pair without a clear window has nulls. A task holds the windows of one
    pair at a time, ``span`` squared pixels, whatever the frames' size."""
    return register_tiles(tiled(df, keys, frame, value, valid), keys, span, pixel, limit)


def register_tiles(tiles: DataFrame, keys: list[str], span: int = 100, pixel: tuple[float, float] = (30.0, 30.0), limit: float = 250.0) -> DataFrame:
    """``register_frames`` of frames that come in tiles (see ``tiled``)."""
    told = [*keys, "a_frame", "b_frame"]
    pairs = written(tile_pairs(tiles, keys))
    windows = written(clearest_windows(pairs, keys, span))
    meets = lambda c: F.col(f"t{c}").between(F.floor(F.col(f"{c}0") / TILE), F.floor((F.col(f"{c}0") + span - 1) / TILE))
    inside = pairs.join(windows, told).where(meets("y") & meets("x"))
    schema = T.StructType([*inside.select(*told, "y0", "x0", "clear").schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("dy", "dx", "degrees", "r")]])
    across = (span - 1) // TILE + 2

    def fit(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        y0, x0 = found["y0"][0].as_py(), found["x0"][0].as_py()
        y, x = found["ty"].to_numpy() - y0 // TILE, found["tx"].to_numpy() - x0 // TILE
        images = np.full((2, across, across, TILE, TILE), np.nan)
        for k, c in enumerate("ab"):
            images[k, y, x] = tile_values(found[c].chunk(0))[0].reshape(-1, TILE, TILE)
        images = images.swapaxes(2, 3).reshape(2, across * TILE, across * TILE)
        images = images[:, y0 % TILE : y0 % TILE + span, x0 % TILE : x0 % TILE + span]
        fitted = rigid_fit(*np.nan_to_num(images), *~np.isnan(images))
        one = found.select([*told, "y0", "x0", "clear"]).slice(0, 1)
        return pa.Table.from_arrays([*one.columns, *[pa.array([float(v)]) for v in fitted]], names=schema.names)

    # a fit costs far more time than bytes, so partitions must not be merged by size
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = inside.repartition(parts, *told).groupBy(*told).applyInArrow(fit, schema)
    offset = F.hypot(F.col("dx") * pixel[1], F.col("dy") * pixel[0])
    out = pairs.select(*told).distinct().join(fitted, told, "left").withColumn("offset", offset)
    return out.withColumn("verdict", F.when(F.col("dy").isNull(), "no overlap").when(F.col("offset") > limit, "too far").otherwise("ok"))
