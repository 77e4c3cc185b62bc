"""Cells of cameras in their forms, the first of many episode files, the newest run."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from episodica.operators import images
from episodica.sources import episodes, runs


def test_cells(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"from a file")
    both = "struct<bytes:binary,path:string>"
    rows = spark.createDataFrame(
        [(1, 0, (b"a0", None), b"b0"), (1, 1, (None, str(tmp_path / "x.jpg")), None), (1, 2, (None, "gone.jpg"), b"b2"), (1, 3, (None, None), b"b3"), (2, 0, None, b"c0")],
        f"ep long, f long, `observation.images.camera0` {both}, camera1 binary",
    )
    wanted = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 0), (2, 0), (9, 9)], "ep long, f long")
    cameras = ["observation.images.camera0", "camera1"]
    held = {(r.ep, r.f, r.camera): bytes(r.content) for r in images.cells(rows, wanted, cameras).collect()}
    assert held == {(1, 0, "camera0"): b"a0", (1, 0, "camera1"): b"b0", (1, 2, "camera1"): b"b2", (2, 0, "camera1"): b"c0"}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    more = {(r.ep, r.f, r.camera): bytes(r.content) for r in images.cells(rows, wanted, cameras, files).collect()}
    assert more == held | {(1, 1, "camera0"): b"from a file"}
    assert {r.name for r in images.named(images.cells(rows, wanted, ["camera1"])).collect()} == {"episode_000001_camera1_t0000.jpg", "episode_000001_camera1_t0002.jpg", "episode_000002_camera1_t0000.jpg"}
    with pytest.raises(TypeError, match="f holds bigint"):
        images.cells(rows, wanted, ["f"])


def test_the_first_episode_files(spark, tmp_path):
    for e in (7, 3, 12):
        folder = tmp_path / f"chunk-{e % 2:03d}"
        folder.mkdir(exist_ok=True)
        pq.write_table(pa.table({"v": [e] * 2}), folder / f"episode_{e:06d}.parquet")
    of = lambda **other: {r.episode_index for r in episodes.read_episodes(spark, str(tmp_path), **other).collect()}
    assert of(first=2) == {12, 3} and of(first=9) == {3, 7, 12} and of(episodes=[7, 3, 99], first=1) == {3} and of(first=0) == set() and of(episodes=[], first=1) == set()


def test_the_newest_run(spark, tmp_path):
    for k, name in enumerate(("run_b", "run_a", "run_c")):
        (tmp_path / name).mkdir()
        if name != "run_c":
            (tmp_path / name / "summary.csv").write_text("x")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    assert runs.latest(spark, str(tmp_path)).endswith("/run_c") and runs.latest(spark, str(tmp_path), "summary.csv").endswith("/run_a")
    assert runs.latest(spark, str(tmp_path / "none")) is None and runs.latest(spark, str(tmp_path / "run_c")) is None
