"""The tiled cube source: round trips, pushed filters, attempts."""

from __future__ import annotations

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoscope.sources import cube


def pixels(n_frames=3, h=21, w=17, bands=4):
    rng = np.random.default_rng(1)
    rows = [(f, y, x, rng.normal(size=bands).tolist()) for f in range(n_frames) for y in range(h) for x in range(w) if (y, x) != (3, 4)]
    rows[5] = (*rows[5][:3], None)
    rows[6] = (*rows[6][:3], [math.nan] * bands)
    return rows


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('cubes')}/a"
    rows = pixels()
    cube.write_tiles(spark.createDataFrame(rows, "frame int, y int, x int, spectrum array<double>").repartition(5), path, tile=8)
    return path, rows


def same(got, want):
    key = lambda rows: {tuple(r[:3]): None if r[3] is None else [round(v, 12) if v == v else "nan" for v in r[3]] for r in rows}
    return key(got) == key(want)


def test_round_trip(spark, written):
    path, rows = written
    df = cube.read_tiles(spark, path)
    assert df.schema.simpleString() == "struct<frame:int,y:int,x:int,spectrum:array<double>>"
    assert same(df.collect(), rows)
    assert len(glob.glob(f"{path}/*.npz")) == 3 * 3 * 3


@pytest.mark.parametrize(
    ("where", "tiles", "keep"),
    [
        ("frame = 1", 9, lambda f, y, x: f == 1),
        ("frame = 2 and y >= 8 and y < 16 and x <= 7", 1, lambda f, y, x: f == 2 and 8 <= y < 16 and x <= 7),
        ("y = 20 and x > 15", 3, lambda f, y, x: y == 20 and x > 15),
        ("frame in (0, 2) and x = 3", 6, lambda f, y, x: f in (0, 2) and x == 3),
        ("y > 5 and y < 5", 0, lambda f, y, x: False),
        ("frame = 1 and y + x = 9", 9, lambda f, y, x: f == 1 and y + x == 9),
        ("frame = null", 0, lambda f, y, x: False),
    ],
)
def test_a_hyperslab_reads_its_tiles_only(spark, written, where, tiles, keep):
    path, rows = written
    df = cube.read_tiles(spark, path, task_bytes=1).where(where)
    assert df.rdd.getNumPartitions() == max(tiles, 1) or not tiles  # one tile a task; none is an empty task
    assert same(df.collect(), [r for r in rows if keep(*r[:3])])


def test_tiles_share_tasks(spark, written):
    assert cube.read_tiles(spark, written[0]).rdd.getNumPartitions() == 1


def test_leftovers_of_other_attempts_are_not_read(spark, written):
    path, rows = written
    one = glob.glob(f"{path}/f0_0_0-*.npz")[0]
    with open(one, "rb") as src, open(f"{path}/f0_0_0-{'0' * 32}.npz", "wb") as dst:
        dst.write(src.read())
    assert cube.read_tiles(spark, path).count() == len(rows)


def test_modes_and_odd_tables(spark, tmp_path):
    path, schema = f"file://{tmp_path}/c", "frame int, y int, x int, spectrum array<double>"
    cube.write_tiles(spark.createDataFrame([], schema), path)
    assert cube.read_tiles(spark, path).count() == 0
    again = spark.createDataFrame([(0, -1, 70, [1.0]), (0, -1, 70, [1.0])], schema)
    with pytest.raises(Exception, match="holds a cube"):
        cube.write_tiles(again, path)
    cube.write_tiles(again, path, mode="overwrite")
    assert [tuple(r) for r in cube.read_tiles(spark, path).where("y = -1").collect()] == [(0, -1, 70, [1.0])]
    with pytest.raises(Exception, match="one length"):
        cube.write_tiles(spark.createDataFrame([(0, 0, 0, [1.0]), (1, 0, 0, [1.0, 2.0])], schema), path, mode="overwrite")
    assert os.path.exists(f"{tmp_path}/c/{cube.MANIFEST}")


def test_pixel_series_of_a_cube(spark, written):
    path, rows = written
    got = cube.read_tiles(spark, path, task_bytes=1).where((F.col("y") == 10) & (F.col("x") == 10))
    assert got.rdd.getNumPartitions() == 3
    assert same(got.collect(), [r for r in rows if r[1:3] == (10, 10)])
