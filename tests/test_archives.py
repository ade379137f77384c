"""Scene files: members, unique scenes, quality, strips."""

from __future__ import annotations

import io
import os
import tarfile

import numpy as np
import pytest

from phenoscope.sources import archives


def raster(plane):
    out = io.BytesIO()
    np.save(out, plane)
    return out.getvalue()


def files(scene, us, planes):
    out = {f"{scene}_MTL.xml": f"<S><ID>{scene}</ID><TIME>{us}</TIME><EPSG>32610</EPSG></S>".encode()}
    return out | {f"{scene}_{k}.npy": raster(v) for k, v in planes.items()}


def as_folder(root, name, members):
    os.makedirs(root / name)
    for k, v in members.items():
        (root / name / k).write_bytes(v)


def as_archive(root, name, members):
    with tarfile.open(root / f"{name}.tar", "w") as tar:
        for k, v in members.items():
            info = tarfile.TarInfo(f"{name}/{k}")
            info.size = len(v)
            tar.addfile(info, io.BytesIO(v))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("scenes")
    rng = np.random.default_rng(1)
    planes = {s: {"B1": rng.normal(size=(11, 5)), "B2": rng.integers(0, 9, (11, 5)).astype(np.int16), "QA": (rng.random((11, 5)) < q).astype(np.uint8)} for s, q in (("A", 0.1), ("B", 0.2), ("C", 0.95))}
    planes["A"]["B1"][2, 3] = np.nan
    as_archive(at, "a", files("A", 5, planes["A"]))
    as_folder(at, "b", files("B", 9, planes["B"]))
    as_archive(at, "c", files("C", 7, planes["C"]))
    as_folder(at, "A0", files("A", 4, {"B1": np.zeros((11, 5))}))  # the same product again, earlier by name
    as_folder(at, "d", {"D_MTL.xml": b"<S><ID>D</ID></S>", "D_B1.npy": raster(np.ones((11, 5)))})  # a band and the quality are missing
    as_folder(at, "e", {"notes.txt": b"no scene", "E_MTL.xml": b"<S></S>"})
    whole = (at / "a.tar").read_bytes()
    (at / "broken.tar").write_bytes(whole[:700])
    (at / "empty.tar").write_bytes(b"")
    return at, planes


def test_members_are_byte_ranges(spark, root):
    at, _ = root
    rows = archives.read_ranges(archives.members(spark, f"file://{at}")).collect()
    assert {r.source.rpartition("/")[2] for r in rows} == {"a.tar", "c.tar", "A0", "b", "d", "e"}
    for r in rows:
        if r.source.endswith(".tar"):
            with tarfile.open(f"{at}/{r.source.rpartition('/')[2]}") as tar:
                assert tar.extractfile(next(m for m in tar if m.name.endswith(r.member))).read() == bytes(r.content)


def test_scenes_are_unique_and_judged_before_bands_are_read(spark, root):
    at, _ = root
    found = archives.members(spark, f"file://{at}")
    scenes = archives.catalogue(found)
    got = {r.scene: (r.us, r.source.rpartition("/")[2]) for r in scenes.collect()}
    assert got == {"A": (5, "a.tar"), "B": (9, "b"), "C": (7, "c.tar"), "D": (None, "d")}
    # the bands' bytes are out of reach: nothing but quality is opened
    without = found.where("member not like '%_B_.npy'")
    assert {r.scene for r in archives.clear_scenes(scenes, without, 11, lambda m: m != 0, 0.5).collect()} == {"A", "B", "D"}


@pytest.mark.parametrize("strip", [1, 4, 11, 100])
def test_pixels_equal_the_rasters(spark, root, strip):
    at, planes = root
    found = archives.members(spark, f"file://{at}")
    rows = archives.scene_pixels(archives.catalogue(found), found, ["B1", "B2"], 11, strip=strip).collect()
    assert len(rows) == len({(r.scene, r.y, r.x) for r in rows}) == 4 * 55
    for r in rows:
        if r.scene == "D":
            assert r.spectrum is None and r["mask"] == 0
            continue
        want = [float(planes[r.scene][b][r.y, r.x]) for b in ("B1", "B2")]
        assert r["mask"] == planes[r.scene]["QA"][r.y, r.x]
        assert r.spectrum == (None if np.isnan(want).any() else want)
