"""Queries that write what the driver's tables hold to files in the shared folder, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import errors, export, intervals, segment
from episodica.plans import frames as fr
from episodica.plans.registry import query
from episodica.sources import demos, logs, named_files, runs
from episodica.sources.scratch import fresh

C = F.col


def _log_lines(spark, d):
    """A log of JSON lines from the events, in files by event_id % 3 and in the order of event_id: some lines are bad, some blank."""
    bad = F.when(C("event_id") % 11 == 0, F.concat(F.lit("["), C("props"), F.lit("]"))).when(C("event_id") % 13 == 0, F.concat(F.lit("{oops "), C("props")))
    value = F.coalesce(bad, C("props"))
    value = F.when(C("event_id") % 7 == 0, F.concat(F.lit("\n"), value)).otherwise(value)  # a blank line before it
    rows = fr.events(spark, d).select((C("event_id") % 3).alias("part"), "event_id", value.alias("value"))
    folder = fresh(spark, "log-lines")
    rows.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(folder)
    return folder


_LINES = """ll AS (SELECT event_id, event_id % 3 AS part, props, sum(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY event_id % 3 ORDER BY event_id)::BIGINT AS line FROM events)"""


@query(f"{_LINES} SELECT part, line, CASE WHEN event_id % 11 = 0 THEN '[' || props || ']' ELSE '{{oops ' || props END AS value FROM ll WHERE event_id % 11 = 0 OR event_id % 13 = 0")
def bad_lines(spark, d):
    """File and number of each line of a log that is no object."""
    _, bad = logs.read_lines(spark, _log_lines(spark, d), "k long")
    return bad.select(F.regexp_extract("file", r"part=(\d)", 1).cast("long").alias("part"), "line", "value")


@query(f"{_LINES} SELECT part, line, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ll WHERE event_id % 11 <> 0 AND event_id % 13 <> 0")
def good_lines(spark, d):
    good, _ = logs.read_lines(spark, _log_lines(spark, d), "k long", numbers=True)
    return good.select(F.regexp_extract("file", r"part=(\d)", 1).cast("long").alias("part"), "line", "k")


@query("""sl AS (SELECT user_id AS ep, arg_max(event_id, event_id) AS e, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) AS k FROM events GROUP BY user_id)
SELECT ep, CASE e % 6 WHEN 0 THEN 9 WHEN 2 THEN 7 ELSE 0 END AS length, CASE WHEN e % 6 IN (0, 4) THEN 'normalized' WHEN e % 6 IN (1, 3) THEN 'parsed' ELSE 'none' END AS rung,
CASE e % 6 WHEN 0 THEN 'reach:' || k || '-' || (k + 5) || ';' WHEN 1 THEN 'lift:' || k || '-' || k || ';' WHEN 3 THEN 'a:1-2;adjust:3-4;' ELSE '' END AS stages FROM sl""")
def stage_log(spark, d):
    """The last record of each episode in a log whose records have their stages in different places, or none."""
    k, ep = C("k"), C("user_id")
    form = lambda text, *values: F.format_string(text, *values)
    value = (
        F.when(C("event_id") % 6 == 0, form('{"episode_index": %d, "episode_length": 9, "normalized_stages": [{"name": "reach", "start_t": %d, "end_t": %d}]}', ep, k, k + 5))
        .when(C("event_id") % 6 == 1, form('{"episode": %d, "normalized_stages": null, "parsed_response": {"stages": [{"name": " LIFT ", "start_frame": %d}]}}', ep, k))
        .when(C("event_id") % 6 == 2, form('{"episode_index": %d, "n_frames": 7, "parsed_response": null}', ep))
        .when(C("event_id") % 6 == 3, form('{"episode_index": %d, "parsed_response": {"stages": [{"name": "a", "start_t": 1, "end_t": 2}, {"start_t": 3, "end_frame": 4}]}}', ep))
        .when(C("event_id") % 6 == 4, form('{"episode_index": %d, "normalized_stages": [], "parsed_response": {"stages": [{"name": "b"}]}}\n', ep))
        .otherwise(form('{"episode_index": %d}', ep))
    )
    folder = fresh(spark, "stage-log")
    rows = fr.events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long")).select("event_id", value.alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").select("value").write.text(folder)
    line = lambda s: F.concat(s["name"], F.lit(":"), s["start"], F.lit("-"), s["end"], F.lit(";"))
    return logs.stage_log(spark, folder).select("ep", "length", "rung", F.array_join(F.transform("stages", line), "").alias("stages"))


def _demo_files(spark, d):
    """CSV files without keys, one for each episode and hand, and times: some right hands are shorter, some times are too few.

    A hundred episodes share a folder, which one task writes and one task reads.
    """
    text = lambda *columns: F.concat_ws(",", *(F.coalesce(C(c).cast("string"), F.lit('""')) for c in columns))
    files = (
        ("left.csv", "extra,width", F.lit(True), text("b", "a")),
        ("right.csv", "width", C("f") < C("n") - C("ep") % 4, text("b")),
        ("times_left.csv", "t", (C("ep") % 5 != 0) & ((C("ep") % 3 != 1) | (C("f") < C("n") - 9)), text("us")),
        ("times_right.csv", "t", C("ep") % 5 != 0, F.coalesce((C("us") + C("f") * 1000).cast("string"), F.lit('""'))),
    )
    line = lambda head, row: F.concat(F.when(C("f") == 0, f"{head}\n").otherwise(""), row, F.lit("\n"))
    each = F.array_compact(F.array(*(F.when(kept, F.struct(F.lit(name).alias("file"), line(head, row).alias("content"))) for name, head, kept, row in files)))
    rows = fr.frames(spark, d).select("ep", "f", F.inline(each)).withColumn("group", F.floor(C("ep") / 100))
    folder = fresh(spark, "demos")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "group").sortWithinPartitions("group", "ep", "file", "f")
    named_files.write_files(rows.select(F.format_string("%d/%d/%s", "group", "ep", "file").alias("name"), "content"), folder)
    return folder


@query("""dm AS (SELECT ep, min(n) - (ep % 4) AS m, min(n) AS n FROM fr GROUP BY ep HAVING min(n) - (ep % 4) > 0),
dt AS (SELECT dm.ep, m, CASE WHEN dm.ep % 5 = 0 THEN NULL WHEN dm.ep % 3 <> 1 OR greatest(n - 9, 0) >= m THEN 'l' ELSE 'r' END AS side FROM dm)
SELECT dt.ep, dt.m AS n, sum((f + 1) * a)::BIGINT AS left_sum, sum((f + 1) * b)::BIGINT AS right_sum,
  round(coalesce(CASE WHEN dt.m >= 2 AND side IS NOT NULL THEN (dt.m - 1) / nullif((max(us + CASE WHEN side = 'r' THEN f * 1000 ELSE 0 END) FILTER (f = dt.m - 1) - min(us) FILTER (f = 0))::DOUBLE, 0) END, 60.0) * CASE WHEN side IS NULL OR dt.m < 2 THEN 1 ELSE 1e6 END, 6) AS fps
FROM dt JOIN fr ON fr.ep = dt.ep AND f < dt.m GROUP BY dt.ep, dt.m, side""")
def demo_rows(spark, d):
    """Both grippers joined by their rows' places in unkeyed files, and the rate by whichever hand's times are enough."""
    folder = _demo_files(spark, d)
    width = lambda side: demos.columns_of(spark, folder, {f"{side}.csv": "width"}).select("demo", "place", C("value").alias("width"))
    pairs = demos.grippers(width("left"), width("right"))
    sums = pairs.groupBy("demo").agg(F.count(F.lit(1)).alias("n"), *(F.sum(((C("place") + 1) * C(c)).cast("long")).alias(f"{c}_sum") for c in ("left", "right")))
    side = F.regexp_extract("file", r"_(\w+)\.", 1)
    times = demos.columns_of(spark, folder, {"times_left.csv": "t", "times_right.csv": "t"}).select("demo", side.alias("side"), "place", (C("value") / 1e6).alias("t"))
    return demos.with_rates(sums, times).select(C("demo").cast("long").alias("ep"), "n", "left_sum", "right_sum", F.round("fps", 6).alias("fps"))


@query("""SELECT ep, ep % 3 <> 0 AND ep % 4 <> 0 AS valid, CASE WHEN ep % 3 = 0 OR ep % 4 = 0 THEN 'missing ' || concat_ws(', ', CASE WHEN ep % 3 = 0 THEN 'gripper_width_left.csv' END, CASE WHEN ep % 4 = 0 THEN 'gripper_width_right.csv' END) END AS reason,
CASE ep % 7 WHEN 0 THEN 'ego_data/b.mp4' WHEN 1 THEN 'ego_data/s/a.mp4' END AS video FROM sn WHERE (ep % 3 <> 0 AND ep % 4 <> 0) OR ep % 5 <> 0""")
def demo_scan(spark, d):
    """Folders of recordings by what is in them: whole, incomplete with a reason, or none."""
    ep = C("ep")
    files = F.array_compact(F.array(
        F.when(ep % 3 != 0, F.lit("gripper_width_left.csv")), F.when(ep % 4 != 0, F.lit("gripper_width_right.csv")), F.when(ep % 5 != 0, F.lit("right_hand_timestamps.csv")),
        F.when(ep % 7 == 0, F.lit("ego_data/b.mp4")), F.when(ep % 7 == 0, F.lit("ego_data/s/a.mp4")), F.when(ep % 7 == 1, F.lit("ego_data/s/z.mp4")), F.when(ep % 7 == 1, F.lit("ego_data/s/a.mp4")), F.lit("notes.txt"),
    ))
    rows = fr.events(spark, d).select(C("user_id").alias("ep")).distinct().select("ep", F.explode(files).alias("name"))
    folder = fresh(spark, "scan")
    named_files.write_files(rows.select(F.concat("ep", F.lit("/"), "name").alias("name"), C("name").cast("binary").alias("content")), folder)
    found = demos.scanned(demos.listing(spark, folder))
    return found.select(C("demo").cast("long").alias("ep"), "valid", "reason", "video")


@query("SELECT ep, f, k FROM (SELECT ep, k, unnest(range(first, last + 1)) AS f FROM sub)")
def index_files(spark, d):
    """A binary file for each episode, which subtask each frame is of, read back."""
    folder = fresh(spark, "index")
    named_files.write_files(named_files.index_contents(intervals.subtasks(fr.state_points(spark, d))), folder)
    return named_files.read_index(spark, folder)


@query("SELECT ep AS episode_index, n, CAST(2 AS BIGINT) AS versions, array_to_string(list_sort(list_distinct(list(c) FILTER (i IN (2, 3, 5, 6)))), ',') AS keyframes FROM st GROUP BY ep, n")
def replaced_rows(spark, d):
    """Keyframes written into the table that they are computed from, which stays beside it as a backup."""
    folder = fresh(spark, "replace") + "/episodes"
    points = fr.state_points(spark, d).groupBy(C("ep").alias("episode_index"), "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("points"))
    runs.replace(points, folder)
    schema = "episode_index long, n long, points array<long>, keyframes array<long>"
    now = spark.read.schema(schema).json(folder)
    runs.replace(now.withColumn("keyframes", export.keyframes(C("points"), export.chosen(" EventVLA4 "))), folder)
    now, before = spark.read.schema(schema).json(folder), spark.read.schema(schema).json(folder + runs.BACKUP)
    both = now.unionByName(before).groupBy("episode_index", "n").agg(F.count(F.lit(1)).alias("versions"), F.max("keyframes").alias("keyframes"))
    return both.select("episode_index", "n", "versions", F.array_join("keyframes", ",").alias("keyframes"))


@query("SELECT count(*) AS rows, sum(n)::BIGINT AS frames, CAST(2 AS BIGINT) AS runs FROM sn")
def guarded_summary(spark, d):
    """The summary after a full run and a partial one, which leaves it as it was."""
    sizes = fr.frames(spark, d).groupBy(C("ep").alias("episode_index")).agg(F.count(F.lit(1)).alias("n"))
    folder, expected = fresh(spark, "run"), sizes.count()
    summed = lambda rows: rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("frames"))
    kept = [runs.write_run(some, folder, expected, summed) for some in (sizes, sizes.where("episode_index % 2 = 0"))]
    if kept != [True, False]:
        raise AssertionError(f"a full and a partial run gave {kept}")
    count = runs.latest_documents(spark, folder, "episode_index long, n long, run string").select("run").distinct()
    rows = spark.read.schema("rows long, frames long").option("header", True).csv(f"{folder}/summary")
    return rows.join(F.broadcast(count.agg(F.count(F.lit(1)).alias("runs"))), F.lit(True))


@query("""bw AS (SELECT ep, n, ep % 17 = 0 AS gone, ep % 19 = 0 AS short, ep % 23 = 0 AND n > 30 AS gap FROM sn)
SELECT ep, 'EXCEPTION: ' || concat_ws(', ', CASE WHEN short THEN least(n, 4) || ' frames are fewer than 5' WHEN n < 5 THEN n || ' frames are fewer than 5' END, CASE WHEN gone THEN 'tube is missing in ' || (CASE WHEN short THEN least(n, 4) WHEN gap THEN n - 1 ELSE n END) || ' frames' END,
  CASE WHEN gap AND NOT short THEN 'frames are not numbered from 0 without gaps' END) AS why FROM bw WHERE gone OR short OR gap OR n < 5
UNION ALL SELECT ep, concat_ws('; ', CASE WHEN no_tube THEN 'no_tube' END, CASE WHEN no_pestle THEN 'no_pestle' END, CASE WHEN no_grind THEN 'no_grind' END, CASE WHEN no_order THEN 'order' END) AS why
FROM cq JOIN bw USING (ep) WHERE NOT (gone OR short OR gap OR bw.n < 5) AND (no_tube OR no_pestle OR no_grind OR no_order)""")
def flagged_episodes(spark, d):
    """Episodes for review: what their segmentation flags, and errors of those that cannot be segmented, beside all others."""
    ep = C("ep")
    rows = fr.motion(spark, d).withColumn("tube", F.when(ep % 17 != 0, C("tube")))
    rows = rows.where(~((ep % 19 == 0) & (C("f") >= 4)) & ~((ep % 23 == 0) & (C("n") > 30) & (C("f") == 9)))
    good, bad = errors.parted(rows, ["tube", "pestle", "raw", "drift"], least=5)
    return errors.flagged(segment.held_tasks(good, fr.TASK), bad)
