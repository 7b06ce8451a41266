"""Volume files and content copies."""

import os

import numpy as np
import pytest

from typeflow.sources import files, volume_files


def volume(n, ny=3, nx=4, seed=0):
    return np.random.default_rng(seed).normal(size=(n, ny, nx)).astype(np.float32)


def planes(spark, named):
    rows = [(name, z, [float(x) for x in p.ravel()]) for name, v in named.items() for z, p in enumerate(v)]
    return spark.createDataFrame(rows, "volume string, z int, plane array<float>").repartition(4)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "volumes")


NAMED = {f"v{k}": volume(k + 1, seed=k) for k in range(6)}


def test_round_trip(spark, folder):
    volume_files.write_volumes(planes(spark, NAMED), folder, 3, 4)
    assert sorted(os.listdir(folder)) == [f"v{k}.tfv" for k in range(6)]
    raw = open(f"{folder}/v2.tfv", "rb").read()
    assert raw == b"TFV1f4  \x03\0\0\0\x04\0\0\0" + NAMED["v2"].tobytes()
    back = volume_files.read_volumes(spark, folder).collect()
    assert len(back) == 21
    for r in back:
        assert r.plane == [float(x) for x in NAMED[r.volume][r.z].ravel()]
    volume_files.write_volumes(planes(spark, {"v2": NAMED["v5"]}), folder, 3, 4, "f8")
    again = volume_files.read_volumes(spark, folder).where("volume = 'v2'").orderBy("z").collect()
    assert [r.plane for r in again] == [[float(x) for x in p.ravel()] for p in NAMED["v5"]]


def test_only_wanted_planes_are_read(spark, folder, monkeypatch):
    volume_files.write_volumes(planes(spark, NAMED), folder, 3, 4)
    # a file that is no volume at all is not opened where it is not wanted
    with open(f"{folder}/bad.tfv", "wb") as f:
        f.write(b"junk")
    got = volume_files.read_volumes(spark, folder, 1, 2, ["v3", "v4"]).select("volume", "z").collect()
    assert {tuple(r) for r in got} == {(v, z) for v in ("v3", "v4") for z in (1, 2)}
    with pytest.raises(Exception, match="no volume file"):
        volume_files.read_volumes(spark, folder).collect()
    read = []
    plane = volume_files.Layout.plane
    monkeypatch.setattr(volume_files.Layout, "plane", lambda self, file, z: read.append(z) or plane(self, file, z))
    monkeypatch.setattr(volume_files, "SPLIT", 100)  # v1 and larger files are cut; a plane has 48 bytes
    reader = volume_files.VolumeReader(folder, 2, 3, ["v5"])
    parts = reader.partitions()
    assert len(parts) == 4  # 16 + 6 * 48 bytes
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["volume"], r["z"]) for r in rows] == [("v5", 2), ("v5", 3)] and read == [2, 3]
    whole = volume_files.VolumeReader(folder, volumes=["v0", "v3", "v5"])
    assert sorted((r["volume"], r["z"]) for p in whole.partitions() for b in whole.read(p) for r in b.to_pylist()) == [(v, z) for v in ("v0", "v3", "v5") for z in range(len(NAMED[v]))]


@pytest.mark.parametrize("rows", [[("v", 1, [0.0] * 12)], [("v", 0, [0.0] * 11)], [("v", 0, None)], [("v", 0, [None] * 12)], [("v", 0, [0.0] * 12)] * 2, [("a/b", 0, [0.0] * 12)], [(None, 0, [0.0] * 12)]])
def test_what_cannot_be_written_leaves_nothing(spark, folder, rows):
    df = spark.createDataFrame(rows + [("good", 0, [1.0] * 12)], "volume string, z int, plane array<float>")
    with pytest.raises(Exception, match="is due|cannot be a file"):
        volume_files.write_volumes(df, folder, 3, 4)
    assert not os.path.isdir(folder) or os.listdir(folder) == []


def test_empty(spark, folder):
    volume_files.write_volumes(planes(spark, NAMED).where("false"), folder, 3, 4)
    assert volume_files.read_volumes(spark, folder).collect() == []


def test_copies(spark, tmp_path):
    for name, data in (("a", b"x" * 3_000_000), ("b", b""), ("c", b"c")):
        (tmp_path / name).write_bytes(data)
    at = lambda name: str(tmp_path / name)
    pairs = [(at("a"), at("out/a.txt")), (at("b"), at("out/deep/b.txt")), (at("none"), at("out/n.txt")), (at("c"), at("out/two")), (at("a"), at("out/two")), (None, at("out/x")), (at("a"), None), (at("b"), at("out/deep/b.txt"))]
    df = spark.createDataFrame(pairs, "source string, target string").repartition(3)
    copied = files.copy_files(df)
    for _ in range(2):  # a stage that runs again changes nothing
        got = {(r.source, r.target): (r.bytes, (r.error or "")[:17]) for r in copied.collect()}
        assert got == {
            pairs[0]: (3_000_000, ""), pairs[1]: (0, ""), pairs[2]: (None, "FileNotFoundError"), pairs[3]: (None, "several sources f"), pairs[4]: (None, "several sources f"),
            pairs[5]: (None, "no file named"), pairs[6]: (None, "no file named"),
        }
        assert sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path / "out") for f in fs) == ["out/a.txt", "out/deep/b.txt"]
    assert (tmp_path / "out/a.txt").read_bytes() == b"x" * 3_000_000


def test_a_task_that_runs_twice_at_once(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    (tmp_path / "a").write_bytes(os.urandom(5_000_000))
    with ThreadPoolExecutor(4) as pool:
        sizes = list(pool.map(lambda _: files.copy_content(str(tmp_path / "a"), str(tmp_path / "b")), range(8)))
    assert sizes == [5_000_000] * 8 and (tmp_path / "b").read_bytes() == (tmp_path / "a").read_bytes()
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]
