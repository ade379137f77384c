"""Headerless rasters in splits."""

from __future__ import annotations

import numpy as np

from phenoscope.sources import readers, sinks


def test_lines_of_many_splits_are_numbered_in_order(spark, tmp_path):
    """A file of some MB read in splits of a quarter of one, and a second file."""
    a = [f"{i},{'x' * (i % 97)}" for i in range(60_000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(a) + "\n")
    (tmp_path / "in" / "b.txt").write_text("last,0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        df = readers.numbered_lines(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 8
        got = [r.value for r in df.orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [*a, "last,0"]
    assert sorted(r.line for r in df.collect()) == list(range(60_001))


def test_a_raster_comes_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.normal(size=(700, 60))
    data = [(y, x, None if (y, x) == (3, 4) else float(image[y, x])) for y in range(700) for x in range(60)]
    df = spark.createDataFrame(data, "y long, x long, v double").repartition(7)
    sinks.write_raster(df, f"{tmp_path}/r", "v")
    got = {(r.y, r.x): r.value for r in readers.raster_csv(spark, f"{tmp_path}/r").collect()}
    assert got == {(y, x): v for y, x, v in data}


def test_pairs_of_unequal_rasters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n 3 ,no\n")
    (tmp_path / "b.csv").write_text("5,6\n7,8\n9,10")
    rows = readers.raster_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).collect()
    assert {(r.y, r.x): (r.a, r.b) for r in rows} == {(0, 0): (1, 5), (0, 1): (2, 6), (1, 0): (3, 7), (1, 1): (None, 8), (2, 0): (None, 9), (2, 1): (None, 10)}
    (tmp_path / "c.csv").write_text("")
    assert readers.raster_csv(spark, str(tmp_path / "c.csv")).count() == 0
