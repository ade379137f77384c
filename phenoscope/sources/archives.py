"""Scenes in folders and tar archives: members found by their headers, scenes
made unique and judged before any band is read, bands read by strips.

A scene is a folder or a ``.tar`` file with one ``*_MTL.xml`` (``ID``, ``TIME``
in microseconds, ``EPSG``), rasters ``*_B<n>.npy`` of one shape and a quality
raster ``*_QA.npy``. Members are byte ranges of files, so a task opens what it
needs and no archive is unpacked. Text and raster formats are those that need no
library; others plug in as another ``open_rows``.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import _store

#: Rows of a raster that a task reads at once.
STRIP_ROWS = 256
MEMBER = "source string, member string, path string, offset long, size long"
RECORD = "ID string, TIME bigint, EPSG int"


def members(spark: SparkSession, root: str) -> DataFrame:
    """Every member of every scene below ``root``: ``source`` (folder or
    archive), ``member``, and where its bytes lie (``path``, ``offset``,
    ``size``). Archives are walked from header to header, a task each; an
    archive that can't be read to its end has no members."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _store(path)
                found = []
                try:
                    with store.open_input_file(at) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                        found = [(path, m.name.rpartition("/")[2], path, m.offset_data, m.size) for m in tar if m.isfile()]
                except (tarfile.TarError, EOFError):
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["source", "member", "path", "offset", "size"])

    archive = F.col("path").endswith(".tar")
    walked = files.where(archive).repartition(F.col("path")).select("path").mapInArrow(walk, MEMBER)
    name = F.element_at(F.split("path", "/"), -1)
    loose = files.where(~archive).select(F.regexp_replace("path", "/[^/]*$", "").alias("source"), name.alias("member"), "path", F.lit(0).cast("long").alias("offset"), F.col("length").alias("size"))
    return walked.unionByName(loose)


def read_ranges(df: DataFrame, out: str = "content") -> DataFrame:
    """``df`` with the bytes of ``path, offset, size``; for small members."""
    names = df.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [batch.column(names.index(c)).to_pylist() for c in ("path", "offset", "size")]
            got = []
            for path, offset, size in zip(*where, strict=True):
                store, at = _store(path)
                with store.open_input_file(at) as f:
                    f.seek(offset)
                    got.append(f.read(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*names, out])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    return df.mapInArrow(read, f"{types}{out} binary")


def catalogue(found: DataFrame) -> DataFrame:
    """``scene, us, epsg, source``: one row for each product id; of sources
    with the same id the last by name. Only metadata members are read; a scene
    without an id is left out."""
    texts = read_ranges(found.where(F.col("member").endswith("_MTL.xml")))
    record = F.from_xml(F.col("content").cast("string"), RECORD, {"mode": "PERMISSIVE"})
    rows = texts.select("source", record.alias("r")).where("r.ID IS NOT NULL")
    last = rows.groupBy(F.col("r.ID").alias("scene")).agg(F.max(F.struct("source", F.col("r.TIME").alias("us"), F.col("r.EPSG").alias("epsg"))).alias("m"))
    return last.select("scene", "m.us", "m.epsg", "m.source")


def npy_rows(data, offset: int, first: int, count: int) -> tuple[tuple[int, int], np.ndarray]:
    """Shape of a two-dimensional ``.npy`` raster that begins at ``offset`` of
    an open file, and ``count`` of its rows from ``first`` on."""
    data.seek(offset)
    head = io.BytesIO(data.read(1024))
    version = np.lib.format.read_magic(head)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if by_column or len(shape) != 2:
        raise ValueError("rasters are two-dimensional, stored by rows")
    count = max(0, min(count, shape[0] - first))
    data.seek(offset + head.tell() + first * shape[1] * dtype.itemsize)
    raw = data.read(count * shape[1] * dtype.itemsize)
    return shape, np.frombuffer(raw, dtype).reshape(count, shape[1])


def scene_pixels(scenes: DataFrame, found: DataFrame, bands: list[str], height: int, quality: str = "QA", strip: int = STRIP_ROWS, open_rows: Callable = npy_rows) -> DataFrame:
    """``scene, y, x, spectrum, mask`` of the scenes (``scene, source``): a task
    takes a strip of rows of all ``bands``, so the bands of a pixel meet without
    a shuffle. A NaN or a band that a scene lacks makes its spectrum null; a
    scene without a quality raster is clear (0)."""
    suffix = F.regexp_extract("member", r"_([A-Z0-9]+)\.npy$", 1)
    wanted = found.where(suffix.isin([*bands, quality])).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(suffix, F.struct("path", "offset"))))).alias("at"))
    strips = scenes.join(wanted, "source").select("scene", "at", F.explode(F.sequence(F.lit(0), F.lit(max(height - 1, 0)), F.lit(strip))).alias("y0"))
    kind = dict(scenes.dtypes)["scene"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scene, at, y0 in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                planes = {}
                for name, where in at:
                    store, path = _store(where["path"])
                    with store.open_input_file(path) as f:
                        planes[name] = open_rows(f, where["offset"], y0, strip)[1]
                if not planes:
                    continue
                shape = next(iter(planes.values())).shape
                blank = np.full(shape, np.nan)
                cube = np.array([planes.get(b, blank).astype(float) for b in bands]).reshape(len(bands), shape[0] * shape[1]).T
                gone = np.isnan(cube).any(1)
                ends = np.concatenate(([0], np.cumsum(np.where(gone, 0, len(bands))))).astype(np.int32)
                spectra = pa.ListArray.from_arrays(pa.array(ends), pa.array(cube[~gone].ravel()), mask=pa.array(gone))
                y, x = np.divmod(np.arange(shape[0] * shape[1]), max(shape[1], 1))
                mask = planes.get(quality, np.zeros(shape, np.int32)).astype(np.int32).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([scene.as_py()] * len(y), scene.type), pa.array((y + y0).astype(np.int32)), pa.array(x.astype(np.int32)), spectra, pa.array(mask)], ["scene", "y", "x", "spectrum", "mask"])

    parts = int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strips.repartition(parts, "scene", "y0").mapInArrow(read, f"scene {kind}, y int, x int, spectrum array<double>, mask int")


def clear_scenes(scenes: DataFrame, found: DataFrame, height: int, flagged: Callable[[Column], Column], most: float, quality: str = "QA") -> DataFrame:
    """Scenes whose share of ``flagged`` pixels is at most ``most``; only their
    quality rasters are read. A scene without one stays."""
    seen = scene_pixels(scenes, found.where(F.col("member").endswith(f"_{quality}.npy")), [], height, quality)
    share = seen.groupBy("scene").agg(F.avg(flagged(F.col("mask")).cast("double")).alias("share"))
    return scenes.join(share.where(F.col("share") > most).select("scene"), "scene", "left_anti")


def write_scenes(pixels: DataFrame, root: str, bands: int, height: int, width: int) -> None:
    """Writes ``scene`` (text), ``us``, ``epsg``, ``packed`` (archive or folder),
    ``y, x, spectrum, mask`` as scene files; missing pixels are NaN with mask
    255. A task holds one scene."""
    import pandas as pd

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        scene, us, epsg, packed = pdf[["scene", "us", "epsg", "packed"]].iloc[0]
        cube, mask = np.full((bands, height, width), np.nan), np.full((height, width), 255, np.uint8)
        y, x = pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)
        mask[y, x] = pdf["mask"]
        for i, j, s in zip(y, x, pdf["spectrum"], strict=True):
            if s is not None:
                cube[:, i, j] = s
        files = {f"{scene}_MTL.xml": f"<S><ID>{scene}</ID><TIME>{us}</TIME><EPSG>{epsg}</EPSG></S>".encode()}
        for name, plane in [*((f"B{k + 1}", cube[k]) for k in range(bands)), ("QA", mask)]:
            out = io.BytesIO()
            np.save(out, plane)
            files[f"{scene}_{name}.npy"] = out.getvalue()
        store, at = _store(root)
        if packed:
            store.create_dir(at, recursive=True)
            with store.open_output_stream(f"{at}/{scene}.tar") as f, tarfile.open(fileobj=f, mode="w|") as tar:
                for name, data in files.items():
                    info = tarfile.TarInfo(f"{scene}/{name}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        else:
            store.create_dir(f"{at}/{scene}", recursive=True)
            for name, data in files.items():
                with store.open_output_stream(f"{at}/{scene}/{name}") as f:
                    f.write(data)
        return pd.DataFrame({"n": [len(pdf)]})

    # both forms of a scene may be asked for
    pixels.groupBy("scene", "packed").applyInPandas(write, "n long").write.format("noop").mode("overwrite").save()
