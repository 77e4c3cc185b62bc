"""Queries of the stage layer: what a model is shown and answers, and the documents and summaries that a run leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import export, images, intervals, stages, vision
from episodica.plans import frames as fr
from episodica.plans.prelude import _hold
from episodica.plans.registry import query
from episodica.sources import documents, named_files, small_files
from episodica.sources.scratch import fresh

C = F.col
POINTS = ["grasp_tube", "start_pour", "release_tube", "grasp_pestle", "start_grind", "lift_pestle"]


@query("""ve AS (SELECT ep, f, n, a, CASE WHEN n < 5 THEN a::DOUBLE ELSE s5 / 5.0::DOUBLE END AS s FROM sm)
SELECT ep, n, arg_min(a, f)::DOUBLE AS "start", min(a)::DOUBLE AS least, max(a)::DOUBLE AS most, arg_max(a, f)::DOUBLE AS "end", (max(a) - min(a))::DOUBLE AS "range", sum(f * a)::DOUBLE AS points,
  coalesce(array_to_string(list(CAST(round((nxt - s) * 5) AS BIGINT) ORDER BY f) FILTER (nxt IS NOT NULL), ','), '') AS velocity FROM (SELECT *, lead(s) OVER (PARTITION BY ep ORDER BY f) AS nxt FROM ve) GROUP BY ep, n""")
def signal_summaries(spark, d):
    """A signal's summary with all its points and the steps of the smoothed signal."""
    found = stages.signal_summary(fr.frames(spark, d), ["a"])
    total = F.aggregate(F.transform(stages.values_of(C("a")), lambda v, i: v * i), F.lit(0.0), lambda s, x: s + x)
    steps = F.transform("a.full_velocity", lambda p: F.round(p["v"] * 5).cast("long"))
    kept = [C(f"a.{x}").alias(y) for x, y in (("start", "start"), ("min", "least"), ("max", "most"), ("end", "end"), ("range", "range"))]
    return found.select("ep", "n", *kept, total.alias("points"), F.array_join(steps, ",").alias("velocity"))


@query("""SELECT ep, array_to_string(list_sort(list_distinct([0, CAST(round_even((n - 1) / 2.0, 0) AS BIGINT), n - 1])), ',') AS three, array_to_string(list_sort(list_distinct(list_transform(range(0, least(n, 7)), lambda k: CASE WHEN k = 0 THEN 0 WHEN k = least(n, 7) - 1 THEN n - 1 ELSE CAST(round_even(k * ((n - 1) / (least(n, 7) - 1)::DOUBLE), 0) AS BIGINT) END))), ',') AS seven, n AS every FROM sn""")
def shown_frames(spark, d):
    rows = fr.frames(spark, d).groupBy("ep").agg(F.count(F.lit(1)).alias("n"))
    three, seven, every = (stages.chosen_frames(C("n"), mode) for mode in ("uniform3", "uniform7", "all"))
    return rows.select("ep", F.array_join(three, ",").alias("three"), F.array_join(seven, ",").alias("seven"), F.size(every).cast("long").alias("every"))


def _records(spark, d):
    """Replies about the subtasks in six forms; every fourth episode has fixed points."""
    points = fr.state_points(spark, d)
    parts = intervals.subtasks(points).groupBy("ep", "n").agg(F.sort_array(F.collect_list(F.struct("k", "first", "last"))).alias("parts"))
    one = lambda p: F.format_string('{"name": "%s", "start_t": %d, "end_t": %d, "prediction_prompt": "part %d"}', F.array(*map(F.lit, stages.NAMES))[p["k"].cast("int")], p["first"], p["last"], p["k"])
    whole = F.concat(F.lit('```json\n{"stages": ['), F.array_join(F.transform("parts", one), ", "), F.lit("]}\n```"))
    form = C("ep") % 6
    raw = (
        F.when(form == 0, whole)
        .when(form == 1, F.format_string('[{"name": "reach", "start_t": 0, "end_t": %d}]', C("n") - 1))
        .when(form == 2, F.lit("I see no stages"))
        .when(form == 4, F.format_string('{"stages": [{"name": "reach", "start_t": 0, "end_t": 4}, {"name": "x", "start_t": "5"}, {"name": "done", "start_t": 5, "end_t": %d, "instruction": "stop"}]}', C("n") - 1))
        .when(form == 5, F.lit('Well: {"stages": {}}'))
    )
    answers = parts.select("ep", raw.alias("raw_response"), F.when(form == 3, F.lit("TimeoutError()")).alias("error"), (C("ep") / 4.0).alias("latency_s"))
    fixed = points.where("ep % 4 = 0").groupBy("ep").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("points"))
    return stages.records(parts.select("ep", "n"), answers, fixed)


_RECORDS = """rc AS (SELECT ep, n, ep % 6 AS form, ep % 4 = 0 AND ep % 6 NOT IN (2, 3) AS fixed, bool_and(last >= first) AS tidy FROM sub GROUP BY ep, n),
rv AS (SELECT ep, n, form, fixed, fixed OR form IN (0, 1, 4) AS json_valid, fixed OR (form = 0 AND tidy) OR form = 1 AS coverage_ok, CASE WHEN fixed OR form = 0 THEN 7 WHEN form = 1 THEN 1 WHEN form = 4 THEN 3 ELSE 0 END AS stage_count FROM rc)"""


@query(f"{_RECORDS} SELECT ep, n, json_valid, coverage_ok, stage_count, CASE WHEN form = 3 THEN 'TimeoutError()' END AS error FROM rv")
def stage_records(spark, d):
    return _records(spark, d).select("ep", "n", "validation.*", "error")


@query(f"{_RECORDS} SELECT count(*) AS episodes, count(*) FILTER (json_valid) AS valid_json, count(*) FILTER (coverage_ok) AS full_coverage FROM rv")
def stage_counts(spark, d):
    return stages.counts(_records(spark, d))


@query(f"""{_RECORDS}, sk AS (SELECT sub.ep, k, sub.n, CASE WHEN fixed AND k > 0 THEN first + 1 ELSE first END AS a, CASE WHEN fixed AND k < 6 THEN greatest(last + 1, CASE WHEN k > 0 THEN first + 1 ELSE first END) ELSE last END AS b, fixed, form FROM sub JOIN rv USING (ep) WHERE fixed OR form = 0
  UNION ALL SELECT ep, 0, n, 0, n - 1, false, form FROM rv WHERE form = 1 AND NOT fixed UNION ALL SELECT ep, 0, n, 0, 4, false, form FROM rv WHERE form = 4 AND NOT fixed UNION ALL SELECT ep, 1, n, 5, NULL, false, form FROM rv WHERE form = 4 AND NOT fixed UNION ALL SELECT ep, 2, n, 5, n - 1, false, form FROM rv WHERE form = 4 AND NOT fixed)
SELECT ep, k AS stage_index, CASE WHEN form = 4 AND NOT fixed THEN ['reach', 'x', 'done'][k + 1] ELSE ['reach', 'transport', 'place', 'release', 'grasp', 'adjust', 'done'][k + 1] END AS stage_name, a || '-' || coalesce(b::VARCHAR, '') AS stage_interval,
  CASE WHEN form = 0 THEN 'part ' || k WHEN fixed THEN ['Move the gripper toward the test tube.', 'Move the grasped tube toward the mortar.', 'Pour the black powder into the mortar.', 'Release the tube and move toward the pestle.', 'Grasp and position the pestle.', 'Grind the powder with the pestle.', 'Finish the motion.'][k + 1] WHEN form = 4 AND k = 2 THEN 'stop' END AS prediction_prompt,
  CASE WHEN b IS NOT NULL THEN array_to_string(list_transform(range(0, 4), lambda j: greatest(0, least([a, (a + b) // 2, b, greatest(0, least(b + 5, n - 1))][j + 1], n - 1))), ',') END AS frames FROM sk""")
def stage_samples(spark, d):
    """What is checked of each stage later."""
    found = stages.samples(_records(spark, d))
    start, end = C("stage_interval")[0], C("stage_interval")[1]
    clamp = lambda x: F.greatest(F.lit(0), F.least(x, C("n") - 1))
    sizes = fr.frames(spark, d).groupBy("ep").agg(F.count(F.lit(1)).alias("n"))
    four = F.array(*map(clamp, (start, F.floor((start + end) / 2), end, clamp(end + 5))))
    same = found.join(sizes, "ep").withColumn("four", F.when(end.isNotNull(), four))
    shown = F.when(C("four").isNull() | (F.array_distinct("four") == C("check_frames")), C("four"))
    interval = F.concat(start, F.lit("-"), F.coalesce(end.cast("string"), F.lit("")))
    return same.select("ep", "stage_index", "stage_name", interval.alias("stage_interval"), "prediction_prompt", F.array_join(shown, ",").alias("frames"))


@query("SELECT ep, n AS n_frames, p1 AS p1_grasp_tube, p2 AS p2_start_pour, p3 AS p3_release_tube, p4 AS p4_grasp_pestle, p5 AS p5_start_grind, p6 AS p6_lift_pestle, round(p1 / 10.0::DOUBLE, 2) AS \"S0_s\", round((p2 - p1) / 10.0::DOUBLE, 2) AS \"S1_s\", round((p3 - p2) / 10.0::DOUBLE, 2) AS \"S2_s\", round((p4 - p3) / 10.0::DOUBLE, 2) AS \"S3_s\", round((p5 - p4) / 10.0::DOUBLE, 2) AS \"S4_s\", round((p6 - p5) / 10.0::DOUBLE, 2) AS \"S5_s\", round((n - p6) / 10.0::DOUBLE, 2) AS \"S6_s\", concat_ws('|', CASE WHEN no_tube THEN 'no_tube' END, CASE WHEN no_pestle THEN 'no_pestle' END, CASE WHEN no_grind THEN 'no_grind' END, CASE WHEN no_order THEN 'order' END) AS flags FROM (SELECT *, pts[1] AS p1, pts[2] AS p2, pts[3] AS p3, pts[4] AS p4, pts[5] AS p5, pts[6] AS p6 FROM cq)")
def wide_summary(spark, d):
    """The summary table of a run: a row per episode, a column per point and part."""
    return export.wide(fr.state_points(spark, d), fr.segmented(spark, d), POINTS, fps=10)


@query("""ki AS (SELECT sub.ep, k, unnest([first, (first + last) // 2, last]) AS f FROM sub WHERE last >= first), kj AS (SELECT DISTINCT ep, f FROM ki)
SELECT printf('episode_%06d_camera%d_t%04d.jpg', fr.ep, cam, fr.f) AS name, CASE cam WHEN 0 THEN fr.a::VARCHAR ELSE 'b' || fr.b END AS content FROM kj JOIN fr ON fr.ep = kj.ep AND fr.f = kj.f, (VALUES (0), (1)) cams(cam) WHERE cam = 0 OR fr.f % 4 <> 0""")
def keyframe_files(spark, d):
    """The images of the frames that are shown of each part, written as files and read back; of one camera some are missing."""
    cell = lambda text: F.struct(F.encode(text, "UTF-8").alias("bytes"), F.lit(None).cast("string").alias("path"))
    rows = fr.frames(spark, d).select("ep", "f", cell(C("a").cast("string")).alias("camera0"), F.when(C("f") % 4 != 0, cell(F.concat(F.lit("b"), "b"))).alias("camera1"))
    parts = intervals.subtasks(fr.state_points(spark, d)).where("last >= first")
    wanted = parts.select("ep", F.explode(F.array(C("first"), F.floor((C("first") + C("last")) / 2), C("last"))).alias("f"))
    folder = fresh(spark, "keyframes")
    # A hundred episodes share a folder, which one task writes, the commit moves as a whole and one task reads.
    group = F.floor(C("ep") / 100)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = images.cells(rows, wanted, ["camera0", "camera1"]).repartition(parts, group).sortWithinPartitions(group)
    files = images.named(held, F.concat(group.cast("string"), F.lit("/")))
    named_files.write_files(files, folder)
    return small_files.contents(spark, folder).select(F.element_at(F.split("name", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("content"))


@query("SELECT ep, 'second' AS task, array_to_string(list(c + CASE WHEN ep % 5 = 0 THEN 1 ELSE 0 END ORDER BY i), ',') AS points, CASE WHEN ep % 3 = 0 THEN '2,5' ELSE '' END AS review FROM st WHERE ep % 4 <> 3 GROUP BY ep UNION ALL SELECT ep, NULL, NULL, NULL FROM sn WHERE ep % 4 = 3")
def document_points(spark, d):
    """Documents of episodes, written as files and read back; those that say another episode's number come after its own."""
    points = fr.state_points(spark, d).where("ep % 4 <> 3").groupBy("ep").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"].cast("int")).alias("critical_points"))
    docs = points.select(C("ep").cast("int").alias("episode_index"), F.lit("second").alias("task"), "critical_points", F.when(C("ep") % 3 == 0, F.array(F.lit(2), F.lit(5))).alias("review_points"))
    later = docs.where("episode_index % 5 = 0").withColumn("critical_points", F.transform("critical_points", lambda x: x + 1))
    folder = fresh(spark, "documents")
    named_files.write_documents(docs.withColumn("task", F.when(C("episode_index") % 5 == 0, "first").otherwise(C("task"))), folder)
    body = F.to_json(F.struct(*later.columns))
    named_files.write_files(later.select(F.format_string("ep%d_subtasks.json", C("episode_index") + 999_000_000).alias("name"), body.alias("content")), folder)
    found = documents.annotation_map(spark, folder)
    rows = fr.frames(spark, d).select(C("ep").cast("int").alias("ep")).distinct().join(found, "ep", "left")
    six, review = documents.points_of(C("document"))
    return rows.select(C("ep").cast("long").alias("ep"), "document.task", F.array_join(six, ",").alias("points"), F.when(C("document").isNotNull(), F.array_join(review, ",")).alias("review"))


@query(f"""ez AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n, sum(energy) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS e3 FROM en),
ey AS (SELECT ep, f - n // 10 AS f, n, e3, min(e3) OVER (PARTITION BY ep) AS lo3 FROM ez WHERE f >= n // 10 AND f < n - n // 10),
ex AS (SELECT *, e3 > lo3 + 0.5 * (quantile_cont(e3, 0.9) OVER (PARTITION BY ep) - lo3) AS hi3 FROM ey),
{_hold("seen", "ex", "hi3", 5)}
SELECT ep, n // 10 + CASE WHEN ok THEN s ELSE CAST(floor(0.25::DOUBLE * (n - 2 * (n // 10))) AS BIGINT) END AS onset, ok FROM (SELECT q.ep, q.n, s, q.n - 2 * (q.n // 10) >= 3 AND q.top > 0 AND e - s >= 4 AS ok FROM (SELECT ep, max(n) AS n, max(e3) AS top FROM ex GROUP BY ep) q JOIN hseen USING (ep))""")
def vision_onsets(spark, d):
    """Onsets of high energy in a window of each recording, smoothed, with a least length and a fallback."""
    from episodica.plans.catalogue import _energy

    rows = _energy(spark, d)
    tenth = F.floor(C("n") / 10)
    windows = rows.groupBy("ep").agg(F.count(F.lit(1)).alias("n")).select("ep", tenth.alias("lo"), (C("n") - tenth).alias("hi"))
    return vision.onsets(vision.smoothed(rows, 0.3, 10), windows, fps=10)
