"""Readers, writers and calls of models on small files, and edge cases of operators on small vectors."""

import pytest
from pyspark.sql import functions as F

from episodica.functions import arrays, replies
from episodica.operators import export, quality, segment, verify
from episodica.sources import episodes


def test_episode_files(spark, tmp_path):
    for e in (3, 12):
        folder = tmp_path / "data" / f"chunk-{e % 2:03d}"
        folder.mkdir(parents=True)
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"observation.state": [[float(e), k] for k in range(4)], "other": [1] * 4}), folder / f"episode_{e:06d}.parquet")
    whole = episodes.read_episodes(spark, str(tmp_path), ["observation.state"])
    assert whole.columns == ["episode_index", "frame", "observation.state"]
    assert sorted((r[0], r[1], r[2][1]) for r in whole.collect()) == [(e, k, float(k)) for e in (3, 12) for k in range(4)]
    assert {r[0] for r in episodes.read_episodes(spark, str(tmp_path), ["observation.state"], [12, 99]).collect()} == {12}
    assert episodes.read_episodes(spark, str(tmp_path), ["observation.state"], []).count() == 0
    with pytest.raises(Exception, match="not an episode file"):
        spark.range(1).select(episodes.episode_of(F.lit("x/y.parquet"))).collect()


def test_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1}\n\n{bad\n{"a": 2, "b": "x"}\n[1]\n')
    good, bad = episodes.read_lines(spark, str(path), "a int, b string")
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, None), (2, "x")] and sorted(r.value for r in bad.collect()) == ["[1]", "{bad"]
    with pytest.raises(Exception):
        episodes.read_lines(spark, str(path), "a int, b string", strict=True)[0].collect()


def test_gripper_columns_in_any_order(spark, tmp_path):
    path = tmp_path / "gripper.csv"
    path.write_text("width,extra,frame\n0.5,x,0\n0.25,y,1\n")
    assert [tuple(r) for r in episodes.read_gripper(spark, str(path)).sort("frame").collect()] == [(0, 0.5), (1, 0.25)]


def test_documents_and_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t", [1, 2]), (2, None, None)], "episode_index int, task string, critical_points array<int>")
    episodes.write_documents(rows, str(tmp_path / "docs"))
    back = episodes.read_documents(spark, str(tmp_path / "docs"))
    assert sorted((r.episode_index, r.task, r.critical_points) for r in back.collect()) == [(1, "t", [1, 2]), (2, None, None)]
    for k in range(2):
        episodes.append_results(spark.createDataFrame([(k, 0.5)], "ep int, score double"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_calls_that_fail_become_errors(spark):
    def client():
        seen = []

        def call(prompt):
            seen.append(prompt)
            if prompt == "bad" or (prompt == "once" and seen.count("once") == 1):
                raise ValueError("no")
            return prompt.upper()

        return call

    asked = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "once")], "request_id string, prompt string").coalesce(1)
    got = {r.request_id: (r.raw_response, r.error) for r in verify.ask(asked, client, retries=2, pause=0.0).collect()}
    assert got == {"1": ("GOOD", None), "2": (None, "ValueError: no"), "3": ("ONCE", None)}


@pytest.mark.parametrize("mask,gap,want", [([], 3, (0, 0)), ([0, 0], 3, (0, 0)), ([1, 1, 0, 1, 1], 0, (0, 2)), ([1, 0, 0, 1, 0], 3, (0, 4)), ([1, 0, 0, 1, 0], 2, (0, 1)), ([0, 1, 0, 1, 1], 1, (3, 5)), ([1, 1, 1], 2, (0, 3))])
def test_hold(spark, mask, gap, want):
    df = spark.createDataFrame([([bool(x) for x in mask],)], "m array<boolean>")
    assert tuple(df.select(arrays.hold(F.col("m"), gap).alias("h")).first().h) == want


def test_constant_and_short_signals(spark):
    df = spark.createDataFrame([([5, 5, 5],), ([1, 2, 3, 4],)], "v array<long>")
    got = [tuple(r) for r in df.select(arrays.norm01(F.col("v")), arrays.rest(F.col("v")), arrays.percentile(F.col("v"), 0.5)).collect()]
    assert got[0] == ([0.0, 0.0, 0.0], 5.0, 5.0) and got[1][1:] == (2.5, 2.5)
    flat = spark.createDataFrame([(1, f, 5, 5, 0, 0) for f in range(30)], "ep long, f long, tube long, pestle long, raw long, drift long")
    row = segment.held_tasks(flat, segment.Hold(fps=10)).first()
    assert row.flags[:3] == ["no_tube", "no_pestle", "no_grind"] and len(row.cps) == 6 and row.cps == sorted(row.cps)


def test_points_of_exports(spark):
    assert export.chosen("pour_grind") == export.chosen(" Pour_Grind\n") == (1, 4) and export.chosen("2, 3") == (1, 2)
    for bad in ("", "0", "7", "x"):
        with pytest.raises(ValueError):
            export.chosen(bad)
    df = spark.createDataFrame([([184, 215, 281, 490, 545, 680], 600)], "c array<long>, n long")
    steps = export.keyframes(F.col("c"), export.chosen("eventvla4"))
    kept, outside = export.inside(steps, F.col("n"))
    assert tuple(df.select(kept, outside).first()) == ([215, 281, 545, 599], [680])
    with pytest.raises(Exception, match="outside its episode"):
        df.select(export.inside(steps, F.col("n"), strict=True)[0]).collect()
    short = spark.createDataFrame([([1, 2],)], "c array<long>")
    for few in (short, short.select(F.lit(None).cast("array<long>").alias("c"))):
        with pytest.raises(Exception, match="six points"):
            few.select(export.keyframes(F.col("c"), (0,))).collect()
    annotations = spark.createDataFrame([(5, [1, 2, 3, 4, 5, 6], None)], "ep long, points array<long>, names array<string>")
    wanted = spark.createDataFrame([(5, 100), (6, 100)], "episode_index long, length long")
    with pytest.raises(Exception, match="no annotation"):
        export.exported(wanted, annotations, "1", strict=True).collect()
    rows = {r.episode_index: r for r in export.exported(wanted, annotations, " POUR_grind ").collect()}
    assert rows[5].keyframe_steps == rows[5].inspect_keyframe_steps == [2, 5] and rows[5].source.critical_points == [1, 2, 3, 4, 5, 6]
    assert rows[5].source.critical_names[0] == "grasp_tube" and rows[6].source is None and rows[6].keyframe_steps == []


def test_shapes_of_replies(spark):
    cases = {
        '[{"stages": [{"name":"a"}]}]': '{"stages":[{"name":"a"}]}',
        '[{"name": "a"}, {"name": "b"}]': '{"stages":[{"name": "a"}, {"name": "b"}]}',
        '```json\n{"stages": []}\n```': '{"stages": []}',
        'list [{"name":"a"}]': '{"name":"a"}',
        'list [{"name":"a"}, {"name":"b"}] end': '{"stages":[{"name":"a"}, {"name":"b"}]}',
        "[]": '{"stages":[]}',
        "[1]": None, "7": None, "no json": None, "{oops": None, '{"a":1}, "b": {"c":2}': None, '{"a":1}] [{"b":2}': None,
    }
    df = spark.createDataFrame([(r,) for r in cases], "r string")
    got = [x[0] for x in df.select(replies.shaped(replies.json_value(F.col("r"), lists=True))).collect()]
    assert got == list(cases.values())


def test_numbers_of_replies(spark):
    cases = {'{"v": 7}': (7, False), '{"v": -7.9}': (-7, False), '{"v": " 12 "}': (12, False), '{"v": "1.5"}': (None, True), '{"v": "x"}': (None, True), '{"v": null}': (None, True), "{}": (None, False), '{"v": [1]}': (None, True)}
    df = spark.createDataFrame([(r,) for r in cases], "r string").select(F.try_variant_get(F.parse_json("r"), "$.v", "variant").alias("v"))
    assert [tuple(r) for r in df.select(*replies.whole_number(F.col("v"))).collect()] == list(cases.values())


def test_log_keeps_the_last_score(spark):
    old = spark.createDataFrame([(1, 1, 0.5), (2, 1, None), (3, 1, None)], "ep int, run int, score double")
    new = spark.createDataFrame([(1, 2, None), (2, 2, 0.25), (3, 2, None)], "ep int, run int, score double")
    assert sorted(tuple(r) for r in quality.log(old, new, ["ep"], "run").collect()) == [(1, 1, 0.5), (2, 2, 0.25), (3, 2, None)]


def test_report_names_its_episodes(spark):
    rows = spark.createDataFrame([(3, [1], ["a", "b"], "s"), (1, [], [], None), (10, [2], [], "s"), (2, [], [], None), (12, [4], ["c"], "s")], "episode_index long, keyframe_steps array<long>, warnings array<string>, source string")
    assert tuple(export.summary(rows).first()) == (5, 3, "1,2", "3,12", 2, 3)
    assert tuple(export.summary(rows.where("episode_index = 10")).first()) == (1, 1, None, None, 0, 0)


def test_values_of_a_reply_in_one_struct(spark):
    """Both forms at once are what each gives alone, also where the text begins like JSON, or its part is all of it."""
    texts = ["", None, "  ", "{oops {\"k\": 1}", "{\"k\": 1}", "```json\n[1, 2]\n```", "Sure: [{\"k\": 1}] so", "x [1] {\"a\": 2} y", "[{\"k\": 1}, 5", "true", "nonsense", "-3", "NaN", "\"t\" x", "{} {}", "{\"a\": [1]} {\"b\": 2}"]
    want = {3: (None, None), 4: ('{"k": 1}',) * 2, 5: ("[1, 2]",) * 2, 6: ('{"k": 1}',) * 2, 7: ('{"a": 2}',) * 2, 8: ('{"k": 1}',) * 2, 9: ("true",) * 2, 11: ("-3",) * 2}
    want |= {15: (None, "[1]")}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    both = replies.json_values(F.col("t"))
    got = {r.k: tuple(r)[1:] for r in df.select("k", both["object"], both["any"], replies.json_value(F.col("t")), replies.json_value(F.col("t"), lists=True)).collect()}
    assert got == {k: want.get(k, (None, None)) * 2 for k in range(len(texts))}
