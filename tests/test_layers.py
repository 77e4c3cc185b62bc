"""The stage layer, documents and manifests in folders, onsets in images, on small tables and files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import export, segment, stages, vision
from episodica.sources import demos, documents, named_files


def test_signal_summary(spark):
    rows = [(1, f, float(v)) for f, v in enumerate([3, 1, 4, 1, 5, 9, 2])] + [(2, f, float(v)) for f, v in enumerate([2.123456, 7])] + [(3, 0, 5.0)]
    df = spark.createDataFrame(rows, "ep long, f long, a double")
    got = {r.ep: r for r in stages.signal_summary(df, ["a"]).collect()}
    x = [3, 1, 4, 1, 5, 9, 2]
    smooth = np.convolve(x, np.ones(5) / 5, mode="same")
    assert tuple(got[1].a)[:5] == (3, 1, 9, 2, 8) and [tuple(p) for p in got[1].a.full_points] == list(enumerate(map(float, x)))
    assert [p.v for p in got[1].a.full_velocity] == [round(v, 5) for v in np.diff(smooth)]
    assert [tuple(p) for p in got[2].a.full_points] == [(0, 2.12346), (1, 7.0)] and [p.v for p in got[2].a.full_velocity] == [4.87654] and got[3].a.full_velocity == []
    assert stages.signal_summary(df, ["a"], compact=True).where("ep = 1").select("a.*").columns == ["start", "min", "max", "end", "range"]


def test_chosen_frames(spark):
    for n in (1, 2, 3, 6, 7, 8, 50, 99):
        seven = sorted({int(round(x)) for x in np.linspace(0, n - 1, min(7, n))})
        three = sorted({0, int(round((n - 1) / 2)), n - 1})
        row = spark.range(1).select(*(stages.chosen_frames(F.lit(n).cast("long"), m).alias(m) for m in ("uniform3", "uniform7", "all"))).first()
        assert (row.uniform3, row.uniform7, row["all"]) == (three, seven, list(range(n)))


def validated(stages_, length):
    if not isinstance(stages_, list):
        return False, False, 0
    ok, expected = bool(stages_), 0
    for s in stages_:
        try:
            start, end = int(s["start_t"]), int(s["end_t"])
        except Exception:
            ok = False
            continue
        ok &= start == expected and start <= end < length
        expected = end + 1
    return True, ok and expected == length, len(stages_)


def test_records_of_replies(spark):
    cases = {
        1: [{"name": "a", "start_t": 0, "end_t": 4}, {"name": "b", "start_t": 5, "end_t": 9}],
        2: [{"name": "a", "start_t": 0, "end_t": 4}, {"name": "b", "start_t": 6, "end_t": 9}],
        3: [{"name": "a", "start_t": "0", "end_t": 4.9}, {"name": "b", "start_t": 5, "end_t": 9}],
        4: [{"name": "a", "start_t": 0, "end_t": 4}, {"name": "gone"}, {"name": "b", "start_t": 5, "end_t": 9}],
        5: [{"name": "a", "start_t": 0, "end_t": 12}], 6: [], 7: "none", 8: [{"start_t": 0, "end_t": 9}], 9: [{"start_t": 0, "end_t": -1}, {"start_t": 0, "end_t": 9}],
    }
    episodes = spark.createDataFrame([(e, 10) for e in [*cases, 20, 21, 22]], "ep long, n long")
    answers = [(e, json.dumps({"stages": s}), None) for e, s in cases.items()] + [(20, None, "TimeoutError"), (22, '{"stages": [{"prediction_prompt": "mine", "reason": ""}]}', None)]
    answers = spark.createDataFrame(answers, "ep long, raw_response string, error string").withColumn("latency_s", F.lit(1.5))
    points = spark.createDataFrame([(22, [1, 2, 3, 4, 5, 6]), (1, [1, 2, 3])], "ep long, points array<long>")
    found = stages.records(episodes, answers, points)
    got = {r.ep: r for r in found.collect()}
    for e, s in cases.items():
        assert tuple(got[e].validation) == validated(s, 10), e
    assert tuple(got[20].validation) == tuple(got[21].validation) == (False, False, 0) and got[20].error == "TimeoutError" and got[21].parsed_response is None
    whole = json.loads(got[22].parsed_response)
    assert tuple(got[22].validation) == (True, True, 7) and [(s["start_t"], s["end_t"]) for s in whole["stages"]] == [(0, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 9)]
    assert whole["stages"][0]["prediction_prompt"] == "mine" and whole["stages"][0]["reason"] == stages.REASON and whole["stages"][6]["expected_future_observation"] == stages.EXPECTED["done"]
    assert whole["boundary_source"] == stages.SOURCE and tuple(stages.counts(found).first()) == (12, 9, 4)
    of = {(r.ep, r.stage_index): r for r in stages.samples(found).collect()}
    assert of[1, 0].check_frames == [0, 2, 4, 9] and of[1, 1].check_frames == [5, 7, 9] and of[22, 1].prediction_prompt == stages.PROMPTS["transport"]


def test_a_run_is_written_whole(spark, tmp_path):
    episodes = spark.createDataFrame([(e, 4) for e in range(12)], "ep long, n long")
    answers = spark.createDataFrame([(e, '{"stages": [{"name": "é", "start_t": 0, "end_t": 3}]}' if e % 2 else "none", None, 0.5) for e in range(11)], "ep long, raw_response string, error string, latency_s double")
    for _ in range(2):
        stages.write_stage_run(stages.records(episodes, answers), str(tmp_path), "some model")
    records = spark.read.json(str(tmp_path / "stage_annotations"))
    assert records.count() == 12 and "é" in records.where("ep = 1").first().parsed_response
    summary = spark.read.option("header", True).csv(str(tmp_path / "summary"))
    assert summary.count() == 12 and summary.where("json_valid = 'true' AND coverage_ok = 'true'").count() == 5
    head = (tmp_path / "report/head.md").read_text()
    assert "- full_coverage: 5/12" in head and "`some model`" in head
    lines = [line for p in sorted((tmp_path / "report").glob("part-*")) for line in p.read_text().splitlines()]
    assert len(lines) == 12 and lines[1] == "| 1 | 4 | 1 | true | true | 0.5 |" and lines[11] == "| 11 | 4 | 0 | false | false | - |"


def test_documents_of_a_folder(spark, tmp_path):
    def put(name, **fields):
        (tmp_path / name).write_text(json.dumps(fields))

    six = [1, 2, 3, 4, 5, 6]
    put("ep001_subtasks.json", episode_index=1, critical_points=six, review_points=[2])
    put("ep002_subtasks.json", critical_points=six[:5])
    put("ep003_subtasks.json", episode_index=1, critical_points=six[::-1])
    (tmp_path / "ep004_subtasks.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    got = {r.ep: r.document for r in documents.annotation_map(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 4} and got[1].critical_points == six[::-1] and got[2].critical_points == six[:5] and got[4].critical_points is None
    asked = spark.createDataFrame([(1,), (2,), (9,)], "ep int")
    found = documents.documents_of(spark, str(tmp_path), asked)
    points, review = documents.points_of(F.col("document"))
    assert {r.ep: (r[1], r[2]) for r in found.select("ep", points, review).collect()} == {1: (six, [2]), 2: (None, []), 9: (None, [])}
    assert sorted(r.ep for r in documents.episodes_in(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
    assert [r.ep for r in documents.episodes_in(spark, str(tmp_path), [7, 1, 7]).collect()] == [1, 7]
    put("epx_subtasks.json", episode_index=5)
    with pytest.raises(Exception, match="no episode in the name"):
        documents.annotation_map(spark, str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        documents.annotation_map(spark, str(tmp_path / "empty"))


def test_tasks(spark, tmp_path):
    assert documents.task_of(spark, str(tmp_path / "none.jsonl")) == documents.TASK
    for text, want in (('{"task": "one"}\n{"task": "two"}\n', "one"), ("{}\n", documents.TASK), ("", documents.TASK)):
        (tmp_path / "tasks.jsonl").write_text(text)
        assert documents.task_of(spark, str(tmp_path / "tasks.jsonl")) == want
    import pandas as pd

    pd.DataFrame({"task_index": [0, 1]}, index=["pour", "grind"]).to_parquet(tmp_path / "tasks.parquet")
    tasks = documents.task_table(spark, str(tmp_path / "tasks.parquet"))
    rows = spark.createDataFrame([(k, k % 3) for k in range(6)], "ep long, task_index long")
    assert [r.task for r in documents.with_tasks(rows, tasks).sort("ep").collect()] == ["pour", "grind", "task_index_2"] * 2
    assert {r.task for r in documents.with_tasks(rows, tasks, " wipe ").collect()} == {"wipe"}


def test_manifests(spark, tmp_path):
    rows = [("d1/ego_data/s/manifest.json", '{"session_start_unix_us": 5, "session_start_ticks_us": 7, "x": [1]}'), ("d2/ego_data/s/manifest.json", "{broken"), ("d3/manifest.json", "{}")]
    named_files.write_files(spark.createDataFrame(rows, "name string, content string"), str(tmp_path))
    assert sorted(tuple(r) for r in documents.manifests(spark, str(tmp_path)).collect()) == [("d1", 5, 7), ("d2", None, None)]
    named_files.write_files(spark.createDataFrame([("d1/ego_data/s/left.jsonl", '{"timestamp_ns": 3}\nbad\n{"x": 1}\n{"timestamp_ns": 9}\n{"timestamp_ns": 4} x\n')], "name string, content string"), str(tmp_path))
    stamps = demos.stamps_of(spark, f"{tmp_path}/d1/ego_data/s/left.jsonl", r"/(d\d)/")
    assert sorted(tuple(r) for r in stamps.collect()) == [("d1", 0, 3), ("d1", 1, 9)]


def test_wiping_without_a_pose(spark):
    """Holds are found from the grippers alone; the wipe then starts a quarter into the cloth's hold."""
    close = lambda f, a, b: 100 if a <= f < b else 1000
    rows = [(1, f, close(f, 20, 180), close(f, 60, 140), None, None, None, None) for f in range(200)]
    df = spark.createDataFrame(rows, "ep long, f long, left long, right long, left_raw long, left_drift long, right_raw long, right_drift long")
    found = vision.with_roles(segment.wiped(df, segment.Wipe(fps=10)))
    row = found.first()
    assert row.cps == [20, 60, 80, 140, 180] and row.flags == ["no_wipe", "holder=left", "wiper=right"]
    assert found.select(vision.needs_review(F.col("flags"))).first()[0]
    assert not spark.range(1).select(vision.needs_review(F.array(F.lit("holder=left"), F.lit("wiper=right")))).first()[0]


def test_onsets_in_images(spark):
    def plain(e, fps, lo, hi):
        win = np.array(e[lo:hi], float)
        if len(win) < 3 or win.max() <= 0:
            return lo + int(0.25 * (hi - lo)), False
        mask = list(win > win.min() + 0.5 * (np.percentile(win, 90) - win.min()))
        k, gap = 0, int(0.5 * fps)
        while k < len(mask):
            if not mask[k]:
                end = k
                while end < len(mask) and not mask[end]:
                    end += 1
                if 0 < k and end < len(mask) and end - k < gap:
                    mask[k:end] = [True] * (end - k)
                k = end
            k += 1
        best, at = (0, 0), None
        for k, on in enumerate([*mask, False]):
            if on and at is None:
                at = k
            if not on and at is not None:
                best, at = max(best, (k - at, -at)), None
        return (lo - best[1], True) if best[0] >= int(0.4 * fps) else (lo + int(0.25 * (hi - lo)), False)

    r = np.random.default_rng(2)
    cases = {ep: ([int(x) for x in r.integers(0, 40, 60) + 200 * (np.arange(60) > r.integers(5, 55)) * (r.random(60) < 0.8)], *sorted(r.integers(0, 61, 2).tolist())) for ep in range(40)}
    cases[50], cases[51] = ([0] * 60, 0, 60), ([5] * 60, 10, 12)
    rows = spark.createDataFrame([(ep, f, v) for ep, (e, *_) in cases.items() for f, v in enumerate(e)], "ep long, f long, energy long")
    windows = spark.createDataFrame([(ep, lo, hi) for ep, (_, lo, hi) in cases.items()], "ep long, lo long, hi long")
    got = {x.ep: (x.onset, x.ok) for x in vision.onsets(rows, windows, fps=10).collect()}
    assert got == {ep: plain(e, 10, lo, hi) for ep, (e, lo, hi) in cases.items()}


def test_wide_summary(spark):
    points = spark.createDataFrame([(1, 1, 10, 60), (1, 2, 35, 60), (2, 1, 3, 8), (2, 2, 5, 8)], "ep long, i long, c long, n long")
    flags = spark.createDataFrame([(1, ["a", "b"])], "ep long, flags array<string>")
    rows = {r.ep: tuple(r)[1:] for r in export.wide(points, flags, ["up", "down"], fps=10).collect()}
    assert rows == {1: (60, 10, 35, 1.0, 2.5, 2.5, "a|b"), 2: (8, 3, 5, 0.3, 0.2, 0.3, "")}
