"""Numbers of lines and places of rows over many splits of a file; logs and folders of recordings built on them."""

import json

import pytest
from pyspark.sql import functions as F

from episodica.sources import demos, logs, places


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_over_many_splits(spark, tmp_path, small_splits):
    lines = {name: [("" if k % 9 == 4 else "   " if k % 9 == 5 else json.dumps({"a": k, "pad": "x" * (k % 40)})) for k in range(n)] for name, n in (("a.jsonl", 400), ("b.jsonl", 3), ("c.jsonl", 150))}
    lines["a.jsonl"][317] = "{bad"
    lines["c.jsonl"][99] = "[1]"
    lines["c.jsonl"][100] = '{"a": 1} and more'
    for name, held in lines.items():
        (tmp_path / name).write_text("\n".join(held) + "\n")
    got = places.numbered(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in got) == sorted((name, k, v) for name, held in lines.items() for k, v in enumerate(held, 1))
    assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 5
    good, bad = logs.read_lines(spark, str(tmp_path), "a long", numbers=True)
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in bad.collect()) == [("a.jsonl", 318, "{bad"), ("c.jsonl", 100, "[1]"), ("c.jsonl", 101, '{"a": 1} and more')]
    assert all(r.a == r.line - 1 for r in good.collect())
    with pytest.raises(Exception, match=r"a\.jsonl:318 is not a JSON object"):
        logs.read_lines(spark, str(tmp_path / "a.jsonl"), "a long", strict=True)[0].collect()
    assert logs.read_lines(spark, str(tmp_path / "b.jsonl"), "a long", strict=True)[0].count() == 3


def test_stage_log_takes_the_last_line(spark, tmp_path, small_splits):
    records = [
        {"episode_index": 1, "normalized_stages": [{"name": "first", "start_t": 0, "end_t": 1}]},
        *({"episode_index": 2, "pad": "x" * 50, "normalized_stages": [{"start_t": k}]} for k in range(60)),
        {"episode": 1, "n_frames": 9, "normalized_stages": None, "parsed_response": {"stages": [{"name": " Place ", "start_frame": 2, "end_t": 30}, {"name": ""}]}},
        {"normalized_stages": [], "parsed_response": {"stages": [{"name": "not this"}]}},
        {"episode_index": 3, "parsed_response": {"stages": "none"}}, {"episode_index": 4, "parsed_response": None}, {"episode_index": 5},
    ]
    (tmp_path / "log.jsonl").write_text("\n\n".join(map(json.dumps, records)))
    found = logs.stage_log(spark, str(tmp_path / "log.jsonl"))
    got = {r.ep: (r.length, r.rung, [tuple(s) for s in r.stages]) for r in found.collect()}
    assert got == {
        1: (9, "parsed", [("place", 2, 30), ("adjust", 0, 0)]), 2: (0, "normalized", [("adjust", 59, 59)]), -1: (0, "normalized", []),
        3: (0, "none", []), 4: (0, "none", []), 5: (0, "none", []),
    }
    clamped = found.where("ep = 1").select(logs.drawn(F.col("stages"), F.col("length")).alias("s")).first().s
    assert [tuple(s) for s in clamped] == [("place", 2, 8), ("adjust", 0, 0)]
    (tmp_path / "bad.jsonl").write_text('{"episode": 1}\n7\n')
    with pytest.raises(Exception, match=r"bad\.jsonl:2 is not a JSON object"):
        logs.stage_log(spark, str(tmp_path / "bad.jsonl")).collect()


def test_reference_points(spark):
    six, new, old = [10, 20, 30, 40, 50, 60], list(logs.POINTS), list(logs.OLD_POINTS)
    cases = [(new, six), (old[::-1], six), (None, six), ([], six), (["x", *new[1:]], six), (new[:4], six), (new, six[:5]), (new, None), ([*new, new[0]], six)]
    want = [six, six[::-1], six, six, six, six, None, None, six]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, names array<string>, points array<int>")
    assert [r[1] for r in df.select("k", logs.reference_points(F.col("names"), F.col("points"))).sort("k").collect()] == want


def test_unkeyed_files_join_by_position(spark, tmp_path, small_splits):
    """Files of unlike length, with columns in other orders, in many splits: the rows of a zip."""
    sides = {"left": {"d1": 300, "d2": 40, "d3": 5}, "right": {"d1": 250, "d2": 90}}
    for side, held in sides.items():
        for demo, n in held.items():
            (tmp_path / demo).mkdir(exist_ok=True)
            head = "width,x\n" if side == "left" else 'x,width\n'
            row = (lambda k: f'{k}.5,"a,b"') if side == "left" else (lambda k: f'"a,b",{k + 1000}')
            (tmp_path / demo / f"gripper_width_{side}.csv").write_text(head + "\n".join(map(row, range(n))) + "\n")
    read = lambda side: demos.column_of(spark, f"{tmp_path}/*/gripper_width_{side}.csv", "width", r"/(d\d)/", "width")
    pairs = demos.grippers(read("left"), read("right"))
    want = [(d, k, k + 0.5, k + 1000.0) for d, n in (("d1", 250), ("d2", 40)) for k in range(n)]
    assert sorted((r.demo, r.place, r.left, r.right) for r in pairs.collect()) == want
    times = spark.createDataFrame([("d1", "left", k, k * 0.1) for k in range(249)] + [("d1", "right", k, k * 0.02) for k in range(400)], "demo string, side string, place long, t double")
    rates = {r.demo: (r.n, round(r.fps, 6)) for r in demos.rates(pairs, times).collect()}
    assert rates == {"d1": (250, 50.0), "d2": (40, 60.0)}
    assert demos.rates(pairs, times.limit(0)).where("fps <> 60").count() == 0


def test_folder_scan(spark, tmp_path):
    tree = {
        "good": ["gripper_width_left.csv", "gripper_width_right.csv", "ego_data/s/b.mp4", "ego_data/s/a.mp4"],
        "video next": ["gripper_width_left.csv", "gripper_width_right.csv", "left_hand_timestamps.csv", "ego_data/s/a.mp4", "ego_data/z.mp4"],
        "half": ["gripper_width_right.csv", "right_hand_timestamps.csv"],
        "none of it": ["left_hand_timestamps.csv"],
        "foreign": ["notes.txt", "sub/gripper_width_left.csv"],
        "one file": ["gripper_width_left.csv"],
    }
    for folder, names in tree.items():
        for name in names:
            path = tmp_path / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("x")
    (tmp_path / "gripper_width_left.csv").write_text("not in a folder")
    got = {r.demo: (r.valid, r.reason, r.video) for r in demos.scanned(demos.listing(spark, f"{tmp_path}/")).collect()}
    assert got == {
        "good": (True, None, "ego_data/s/a.mp4"), "video next": (True, None, "ego_data/z.mp4"), "half": (False, "missing gripper_width_left.csv", None),
        "none of it": (False, "missing gripper_width_left.csv, gripper_width_right.csv", None),
    }


def test_rows_by_place(spark):
    rows = spark.createDataFrame([(f"d{k % 7}", k) for k in range(50)], "demo string, k int")
    assert {r.demo for r in demos.by_place(rows, "demo", [0, 3, 99]).collect()} == {"d0", "d3"} and demos.by_place(rows, "demo", []).count() == 0


def test_columns_of_many_small_files(spark, tmp_path):
    """One pass over folders of recordings gives what a reader of each kind of file gives; the driver lists no file."""
    for demo, (n, m) in {"d1": (300, 250), "d2": (40, 90), "d3": (5, 0)}.items():
        (folder := tmp_path / "demos" / f"g{demo[1:]}" / demo).mkdir(parents=True)
        (folder / "left.csv").write_text("width,x\r\n" + "\r\n".join(f'{k}.5,"a,""b"""' for k in range(n)) + "\r\n\r\n")
        (folder / "right.csv").write_text(('x,width\n' + "".join(f'"a,b",{k + 1000}\n' for k in range(m))) if m else "")
        (folder / "notes.txt").write_text("width\nnone\n")
    (tmp_path / "demos/g1/d1/right.csv").open("a").write('"short"\n"",""\n7,8')
    held = demos.columns_of(spark, str(tmp_path / "demos"), {"left.csv": "width", "right.csv": "width"})
    got = sorted(tuple(r) for r in held.where("value IS NOT NULL").collect())
    want = [(d, "left.csv", k, k + 0.5) for d, n in (("d1", 300), ("d2", 40), ("d3", 5)) for k in range(n)]
    want += [(d, "right.csv", k, k + 1000.0) for d, n in (("d1", 250), ("d2", 90)) for k in range(n)] + [("d1", "right.csv", 252, 8.0)]
    assert got == sorted(want) and held.count() == len(want) + 2
    assert held.inputFiles() == []
    with pytest.raises(Exception, match="left.csv has no column height"):
        demos.columns_of(spark, str(tmp_path / "demos"), {"left.csv": "height"}).collect()


def test_rates_by_the_ends_of_times(spark):
    """The left side's times where there are enough, else the right's, else none; other columns stay."""
    frames = spark.createDataFrame([("a", 3, 1), ("b", 3, 2), ("c", 3, 3), ("d", 1, 4), ("e", 2, 5)], "demo string, n long, k long")
    times = [("a", s, k, k / x) for s, x in (("left", 10), ("right", 20)) for k in range(5)] + [("b", s, k, k / x) for s, x, n in (("left", 10, 2), ("right", 20, 3)) for k in range(n)]
    times += [("c", "left", 0, 1.0), ("d", "left", 0, 1.0), ("e", "left", 0, 1.0), ("e", "left", 1, 1.0), ("z", "left", 0, 1.0)]
    df = spark.createDataFrame(times, "demo string, side string, place long, t double")
    assert {r.demo: (r.n, r.k, round(r.fps, 6)) for r in demos.with_rates(frames, df).collect()} == {"a": (3, 1, 10.0), "b": (3, 2, 20.0), "c": (3, 3, 60.0), "d": (1, 4, 60.0), "e": (2, 5, 60.0)}


def test_stamps_in_many_small_files(spark, tmp_path):
    """Counted without the lines that hold none, file by file, in one pass of which the driver lists no file."""
    lines = {f"g{k % 2}/{k}/left.jsonl": ['{"timestamp_ns": oops', "", *(json.dumps({"timestamp_ns": j * 10 + k}) for j in range(k)), "[1]", '{"timestamp_ns": 5} x', '{"x": 1}', '{"timestamp_ns": 7}'] for k in range(9)}
    for name, held in lines.items():
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text("\n".join(held))
    found = demos.stamps_in(spark, str(tmp_path))
    want = sorted((str(k), j, t) for k in range(9) for j, t in enumerate([*(j * 10 + k for j in range(k)), 7]))
    assert sorted(tuple(r) for r in found.collect()) == want and found.inputFiles() == []
    assert sorted(tuple(r) for r in demos.stamps_of(spark, f"{tmp_path}/*/*/left.jsonl", r"/(\d)/left").collect()) == want
