"""Named files with commit and abort, index files, replacement in place, guarded summaries, errors of single episodes."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from episodica.operators import errors, images
from episodica.sources import named_files, runs, small_files


def names_below(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{k}.bin", bytes([k] * k)) for k in range(20)] + [("top.txt", b"x"), ("none", None)], "name string, content binary").repartition(4)
    named_files.write_files(rows, str(tmp_path / "out"))
    assert names_below(tmp_path / "out") == sorted([f"a/{k}.bin" for k in range(20)] + ["none", "top.txt"])
    assert (tmp_path / "out/a/7.bin").read_bytes() == b"\7" * 7 and (tmp_path / "out/none").read_bytes() == b""
    named_files.write_files(rows.where("name = 'top.txt'").withColumn("content", F.lit("new")), str(tmp_path / "out"))
    assert (tmp_path / "out/top.txt").read_text() == "new" and len(names_below(tmp_path / "out")) == 22
    named_files.write_files(rows.where("name = 'none'"), str(tmp_path / "out"), mode="overwrite")
    assert names_below(tmp_path / "out") == ["none"]


def test_a_failed_write_leaves_nothing_behind(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/kept").write_text("old")
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).alias("content"))
    for bad in (rows.repartition(5), spark.createDataFrame([("../escape", "x")], "name string, content string"), spark.createDataFrame([("", "x")], "name string, content string")):
        with pytest.raises(Exception):
            named_files.write_files(bad, str(tmp_path / "out"), mode="overwrite")
        assert names_below(tmp_path) == ["out/kept"] and (tmp_path / "out/kept").read_text() == "old"


def test_index_files(spark, tmp_path):
    parts = [(1, 10, 0, 0, 3), (1, 10, 1, 4, 9), (2, 5, 0, -2, 1), (2, 5, 3, 3, 99), (1000, 1, 2, 0, 0)]
    df = spark.createDataFrame(parts, "ep long, n long, k long, first long, last long").repartition(3)
    named_files.write_files(named_files.index_contents(df), str(tmp_path))
    assert names_below(tmp_path) == ["ep001_subtask_index.npy", "ep002_subtask_index.npy", "ep1000_subtask_index.npy"]
    held = np.load(tmp_path / "ep002_subtask_index.npy")
    assert held.dtype == np.int16 and held.tolist() == [0, 0, 0, 3, 3]
    got = {(r.ep, r.f): r.k for r in named_files.read_index(spark, str(tmp_path)).collect()}
    assert got == {(e, f): k for e, v in {1: [0] * 4 + [1] * 6, 2: [0, 0, 0, 3, 3], 1000: [2]}.items() for f, k in enumerate(v)}
    (tmp_path / "ep003_subtask_index.npy").write_bytes(b"no array")
    with pytest.raises(Exception, match="ep003_subtask_index.npy is no index file"):
        named_files.read_index(spark, str(tmp_path)).collect()


def test_documents_by_name(spark, tmp_path):
    rows = spark.createDataFrame([(3, "é", None), (12, None, [1])], "episode_index int, task string, points array<int>")
    named_files.write_documents(rows, str(tmp_path))
    assert names_below(tmp_path) == ["ep003_subtasks.json", "ep012_subtasks.json"]
    assert json.loads((tmp_path / "ep003_subtasks.json").read_text("utf-8")) == {"episode_index": 3, "task": "é", "points": None}


def test_replace_in_place(spark, tmp_path):
    path = str(tmp_path / "episodes")
    schema = "k long, v string"
    read = lambda p: sorted(tuple(r) for r in spark.read.schema(schema).json(p).collect())
    runs.replace(spark.createDataFrame([(1, "ä"), (2, None)], schema), path)
    assert read(path) == [(1, "ä"), (2, None)]
    runs.replace(spark.read.schema(schema).json(path).withColumn("k", F.col("k") + 10), path)  # reads what it replaces
    assert read(path) == [(11, "ä"), (12, None)] and read(path + runs.BACKUP) == [(1, "ä"), (2, None)]
    failing = spark.read.schema(schema).json(path).withColumn("v", F.when(F.col("k") == 12, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception):
        runs.replace(failing, path)
    assert read(path) == [(11, "ä"), (12, None)] and read(path + runs.BACKUP) == [(1, "ä"), (2, None)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["episodes", "episodes.bak"]
    runs.replace(spark.createDataFrame([(5, "z")], schema), path, backup=False)
    assert read(path) == [(5, "z")] and sorted(p.name for p in tmp_path.iterdir()) == ["episodes"]


def test_a_partial_run_leaves_the_summary(spark, tmp_path):
    docs = spark.createDataFrame([(k, k * 10) for k in range(8)], "episode_index long, n long")
    summed = lambda rows: rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("frames"))
    summary = lambda: [tuple(r) for r in spark.read.schema("rows long, frames long").option("header", True).csv(str(tmp_path / "summary")).collect()]
    assert not runs.write_run(docs.limit(3), str(tmp_path), 8, summed) and not (tmp_path / "summary").exists()
    assert runs.write_run(docs, str(tmp_path), 8, summed) and summary() == [(8, 280)]
    more = docs.withColumn("n", F.col("n") + 1)
    assert not runs.write_run(more.where("episode_index <> 5"), str(tmp_path), 8, summed) and summary() == [(8, 280)]
    twice = more.withColumn("episode_index", F.col("episode_index") % 7)
    assert not runs.write_run(twice, str(tmp_path), 8, summed) and summary() == [(8, 280)]
    assert runs.write_run(more, str(tmp_path), 8, summed) and summary() == [(8, 288)]
    assert spark.read.json(str(tmp_path / "all_subtasks")).count() == 8 and runs.latest_documents(spark, str(tmp_path), "episode_index long, n long").count() == 3 + 8 + 7 + 8 + 8


def test_one_bad_episode_fails_no_job(spark):
    rows = [(ep, f, float(f % 5), float(f)) for ep in range(6) for f in range(30)]
    rows = [r for r in rows if not (r[0] == 1 and r[1] > 2) and not (r[0] == 4 and r[1] == 7)]
    rows = [(e, f, None if e == 2 and f == 3 else a, float("nan") if e == 3 and f < 2 else b) for e, f, a, b in rows]
    good, bad = errors.parted(spark.createDataFrame(rows, "ep long, f long, a double, b double"), ["a", "b"], least=5)
    assert {r.ep for r in good.collect()} == {0, 5}
    assert dict(bad.collect()) == {
        1: "EXCEPTION: 3 frames are fewer than 5", 2: "EXCEPTION: a is missing in 1 frames", 3: "EXCEPTION: b is missing in 2 frames",
        4: "EXCEPTION: frames are not numbered from 0 without gaps",
    }


def test_errors_of_groups_are_rows(spark):
    def step(group: pa.Table) -> pa.Table:
        if group["ep"][0].as_py() == 3:
            raise ValueError("cannot be read")
        return pa.table({"ep": group["ep"][:1], "total": pa.array([pc.sum(group["v"]).as_py()])})

    df = spark.createDataFrame([(k % 5, k) for k in range(50)], "ep long, v long")
    schema = StructType([StructField("ep", LongType()), StructField("total", LongType())])
    got = {r.ep: (r.total, r.error) for r in errors.captured(df, "ep", step, schema).collect()}
    assert got == {e: (None, "EXCEPTION: cannot be read") if e == 3 else (sum(range(e, 50, 5)), None) for e in range(5)}


def test_rows_of_one_name_are_one_file(spark, tmp_path):
    """Parts in their order, and folders that two writes share are merged."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), "id").repartition(2, "k").sortWithinPartitions("k", "id")
    named = rows.select(F.format_string("g%d/x.txt", "k").alias("name"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("content"))
    named_files.write_files(named, str(tmp_path / "out"))
    named_files.write_files(spark.createDataFrame([("g1/y.txt", "y"), ("g1/a/z.txt", "z"), ("g2/x.txt", "new")], "name string, content string").repartition(3), str(tmp_path / "out"))
    assert names_below(tmp_path / "out") == ["g0/x.txt", "g1/a/z.txt", "g1/x.txt", "g1/y.txt", "g2/x.txt"]
    assert all((tmp_path / f"out/g{k}/x.txt").read_text() == "".join(f"{j}\n" for j in range(k, 3000, 3)) for k in (0, 1)) and (tmp_path / "out/g2/x.txt").read_text() == "new"


def test_many_images_in_folders(spark, tmp_path):
    """What the driver gets of a written file is its task's folder; files are listed and read by tasks."""
    cells = spark.range(700).select((F.col("id") % 7).alias("ep"), F.col("id").alias("f"), F.lit("camera0").alias("camera"), F.col("id").cast("string").cast("binary").alias("content"))
    files = images.named(cells.repartition(3, "ep").sortWithinPartitions("ep"), F.concat(F.lit("g"), F.col("ep").cast("string"), F.lit("/")))
    named_files.write_files(files, str(tmp_path / "out"))
    held = small_files.contents(spark, str(tmp_path / "out"))
    assert {r.name: bytes(r.content) for r in held.collect()} == {f"g{k % 7}/episode_{k % 7:06d}_camera0_t{k:04d}.jpg": b"%d" % k for k in range(700)}
    assert held.count() == 700 and held.inputFiles() == [] and set(vars(named_files.Written("x"))) == {"folder"}
