"""Cubes as tiles: a data source whose filters on frame, row and column reach
the tiles, so a hyperslab reads the files that it meets and nothing else.

    cube.register(spark)
    cube.write_tiles(pixels, path, tile=64)          # frame, y, x, spectrum
    spark.read.format("pixel_cube").load(path).where("frame = 3 and y between 10 and 19")

A tile is one file: the spectra of ``tile`` x ``tile`` pixels of a frame and
which of them are there. Files have names of their own for each attempt; the
manifest, written when all tasks are done, names those that count, so repeated
and failed attempts leave nothing behind that is read. A task reads a run of
tiles of about TASK_BYTES; another executor can repeat it at any time.

Defined results: pixels that were not written are not read; a null spectrum is
read as null; NaN stays NaN; of pixels written twice in a write the last counts;
spectra of unequal lengths are refused; an empty table is an empty cube. Filters
by ``=``, ``<``, ``<=``, ``>``, ``>=``, ``IN`` and ``IS NOT NULL`` on the three
places are applied here; others stay with Spark.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

NAME, MANIFEST = "pixel_cube", "manifest.json"
SCHEMA = "frame int, y int, x int, spectrum array<double>"
PLACES = ("frame", "y", "x")
TASK_BYTES = 64 << 20


def _store(path: str):
    """A file system and the path in it; plain paths are local ones."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _write(path: str, data: bytes) -> None:
    store, at = _store(path)
    with store.open_output_stream(at) as f:
        f.write(data)


def _read(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_stream(at) as f:
        return f.read()


@dataclass
class Tiles(InputPartition):
    """Files of one task: ``(name, frame, y0, x0)`` each."""

    files: list


@dataclass
class Written(WriterCommitMessage):
    files: list
    bands: int


class PixelCube(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CubeReader:
        return CubeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CubeWriter:
        if schema.names != [*PLACES, "spectrum"]:
            raise ValueError(f"a cube has the columns {SCHEMA}")
        return CubeWriter(self.options, overwrite)


class CubeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        #: Closed ranges, and sets of values, for each place.
        self.low, self.high, self.among = {}, {}, {}
        self.nothing = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            place = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if place not in PLACES or not self._take(place, f):
                yield f

    def _take(self, place: str, f: Filter) -> bool:
        if isinstance(f, IsNotNull):
            return True  # places are never null
        value = getattr(f, "value", None)
        if isinstance(f, In):
            known = {int(v) for v in value if v is not None}
            self.among[place] = known & self.among.get(place, known)
            return True
        step = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f))
        if step is None:
            return False
        if value is None:
            self.nothing = True
            return True
        if step[0] is not None:
            self.low[place] = max(self.low.get(place, value), int(value) + step[0])
        if step[1] is not None:
            self.high[place] = min(self.high.get(place, value), int(value) + step[1])
        return True

    def _inside(self, place: str, values: np.ndarray) -> np.ndarray:
        ok = (values >= self.low.get(place, -(1 << 62))) & (values <= self.high.get(place, 1 << 62))
        return ok & np.isin(values, [*self.among[place]]) if place in self.among else ok

    def partitions(self) -> list[InputPartition]:
        about = json.loads(_read(f"{self.path}/{MANIFEST}"))
        size = about["tile"]
        met = []
        for name, frame, y0, x0 in about["files"]:
            starts = ((frame, 1), (y0, size), (x0, size))
            if not self.nothing and all(self._inside(p, np.arange(a, a + n)).any() for p, (a, n) in zip(PLACES, starts, strict=True)):
                met.append((name, frame, y0, x0))
        each = max(1, self.task_bytes // (size * size * (8 * about["bands"] + 2)))
        return [Tiles(met[k : k + each]) for k in range(0, len(met), each)]

    def read(self, partition: Tiles | None) -> Iterator[pa.RecordBatch]:
        for name, frame, y0, x0 in partition.files if partition else ():
            with np.load(io.BytesIO(_read(f"{self.path}/{name}"))) as z:
                there, null, spectra = z["there"], z["null"], z["spectra"]
            y, x = np.nonzero(there)
            keep = self._inside("y", y + y0) & self._inside("x", x + x0)
            y, x = y[keep], x[keep]
            rows, gone = spectra[y, x], null[y, x]
            ends = np.concatenate(([0], np.cumsum(np.where(gone, 0, rows.shape[1])))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[~gone].ravel()), mask=pa.array(gone))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), frame, np.int32)), pa.array((y + y0).astype(np.int32)), pa.array((x + x0).astype(np.int32)), lists], ["frame", "y", "x", "spectrum"])


class CubeWriter(DataSourceArrowWriter):
    """Takes rows that are sorted by tile; a task holds one tile."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.tile, self.overwrite = options["path"], int(options.get("tile", 64)), overwrite
        store, at = _store(self.path)
        from pyarrow import fs

        if not overwrite and store.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} holds a cube")
        store.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, held, key, bands = [], [], None, -1
        for batch in iterator:
            place = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            tile = np.stack([place[0], place[1] // self.tile, place[2] // self.tile])
            cuts = [0, *(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                here = tuple(tile[:, lo].tolist())
                if here != key and held:
                    bands = self._tile(key, held, files, bands)
                    held = []
                key = here
                held.append((place[:, lo:hi], batch.column(3).slice(lo, hi - lo)))
        if held:
            bands = self._tile(key, held, files, bands)
        return Written(files, bands)

    def _tile(self, key: tuple, held: list, files: list, bands: int) -> int:
        place = np.concatenate([p for p, _ in held], 1)
        spectra = pa.concat_arrays([s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s for _, s in held])
        gone = spectra.is_null().to_numpy(zero_copy_only=False)
        lengths = set(np.diff(spectra.offsets.to_numpy())[~gone].tolist()) | ({bands} if bands >= 0 else set())
        if len(lengths) > 1:
            raise ValueError("spectra of a cube have one length")
        bands = lengths.pop() if lengths else -1
        n = self.tile
        y, x = place[1] - key[1] * n, place[2] - key[2] * n
        there, null, values = np.zeros((n, n), bool), np.zeros((n, n), bool), np.full((n, n, max(bands, 0)), np.nan)
        there[y, x], null[y, x] = True, gone
        if bands > 0 and not gone.all():
            flat = spectra.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, bands)
            values[y[~gone], x[~gone]] = flat
        out = io.BytesIO()
        np.savez_compressed(out, there=there, null=null, spectra=values)
        name = f"f{key[0]}_{key[1]}_{key[2]}-{uuid.uuid4().hex}.npz"
        _write(f"{self.path}/{name}", out.getvalue())
        files.append((name, key[0], key[1] * n, key[2] * n))
        return bands

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        bands = {m.bands for m in done if m.bands >= 0}
        if len(bands) > 1:
            raise ValueError("spectra of a cube have one length")
        files = sorted((f for m in done for f in m.files), key=lambda f: f[1:])
        _write(f"{self.path}/{MANIFEST}", json.dumps({"tile": self.tile, "bands": max(bands, default=0), "files": files}).encode())


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, its pushdown included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PixelCube)


def write_tiles(pixels: DataFrame, path: str, tile: int = 64, mode: str = "append") -> None:
    """Writes ``frame, y, x, spectrum``: the pixels of a tile meet in one task.
    ``mode``: ``append`` refuses a path that holds a cube, ``overwrite`` replaces it."""
    register(pixels.sparkSession)
    at = [F.col("frame"), F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)]
    rows = pixels.selectExpr("cast(frame as int) AS frame", "cast(y as int) AS y", "cast(x as int) AS x", "cast(spectrum as array<double>) AS spectrum")
    rows.repartition(*at).sortWithinPartitions(*at).write.format(NAME).option("tile", tile).mode(mode).save(path)


def read_tiles(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("taskBytes", task_bytes).load(path)
