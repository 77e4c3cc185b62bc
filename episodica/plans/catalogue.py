"""All queries of the library on the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions import replies, signal
from episodica.functions.arrays import let
from episodica.operators import align, export, fusion, intervals, quality, runs
from episodica.plans import files, layers, reviews  # noqa: F401  register their queries
from episodica.plans import frames as fr
from episodica.plans.prelude import EGO_FALLBACK
from episodica.plans.registry import oracle_sql, queries, query  # noqa: F401  the first two are read from here
from episodica.sources import demos


C, W, P = F.col, signal.ordered, signal.episode


@query("SELECT ep, f, n, a, b FROM fr")
def frames_view(spark, d):
    return fr.frames(spark, d).select("ep", "f", "n", "a", "b")


@query("SELECT ep, arg_min(a, f) AS a_start, min(a) AS a_min, max(a) AS a_max, arg_max(a, f) AS a_end, max(a) - min(a) AS a_range, arg_min(b, f) AS b_start, min(b) AS b_min, max(b) AS b_max, arg_max(b, f) AS b_end, max(b) - min(b) AS b_range FROM fr GROUP BY ep")
def episode_stats(spark, d):
    of = lambda x: [F.min_by(x, "f").alias(f"{x}_start"), F.min(x).alias(f"{x}_min"), F.max(x).alias(f"{x}_max"), F.max_by(x, "f").alias(f"{x}_end"), (F.max(x) - F.min(x)).alias(f"{x}_range")]
    return fr.frames(spark, d).groupBy("ep").agg(*of("a"), *of("b"))


@query("SELECT ep, f, s9, round(s9 / 9.0, 6) AS smoothed FROM sm")
def smooth_signal(spark, d):
    s = signal.smooth_sum(C("a"), 9)
    return fr.frames(spark, d).select("ep", "f", s.alias("s9"), F.round(s / 9.0, 6).alias("smoothed"))


@query("SELECT ep, f, CASE WHEN n < 5 THEN a * 5 ELSE s5 END AS s5 FROM sm")
def smooth_short5(spark, d):
    return fr.frames(spark, d).select("ep", "f", F.when(C("n") < 5, C("a") * 5).otherwise(signal.smooth_sum(C("a"), 5)).alias("s5"))


@query("SELECT ep, f, ga, gb FROM nm")
def norm01(spark, d):
    return fr.normed(spark, d).select("ep", "f", "ga", "gb")


@query("SELECT ep, f, round((a - avg(a) OVER (PARTITION BY ep)) / (stddev_pop(a) OVER (PARTITION BY ep) + 1e-9), 5) AS za, round((b - avg(b) OVER (PARTITION BY ep)) / (stddev_pop(b) OVER (PARTITION BY ep) + 1e-9), 5) AS zb FROM fr")
def zscore_state(spark, d):
    return fr.frames(spark, d).select("ep", "f", *(F.round(signal.zscore(C(x)), 5).alias(f"z{x}") for x in "ab"))


@query("SELECT ep, f, da, db FROM df")
def diff_prepend(spark, d):
    return fr.frames(spark, d).select("ep", "f", *(signal.step(C(x)).alias(f"d{x}") for x in "ab"))


@query("SELECT ep, f, v FROM (SELECT ep, f, lead(s5) OVER (PARTITION BY ep ORDER BY f) - s5 AS v FROM sm) WHERE v IS NOT NULL")
def velocity(spark, d):
    rows = fr.frames(spark, d).withColumn("s", signal.smooth_sum(C("a"), 5))
    return rows.select("ep", "f", (F.lead("s").over(W()) - C("s")).alias("v")).where("v IS NOT NULL")


@query("SELECT ep, f, raw FROM mo")
def vector_speed(spark, d):
    """Length of the steps of the z-scored position, smoothed."""
    return fr.motion(spark, d).select("ep", "f", "raw")


@query("SELECT ep, f, drift FROM mo")
def carrier_drift(spark, d):
    """The same of the smoothed position."""
    return fr.motion(spark, d).select("ep", "f", "drift")


@query("SELECT ep, ra, rb FROM rs")
def rest_level(spark, d):
    return fr.masked(spark, d).groupBy("ep").agg(F.max("ra").alias("ra"), F.max("rb").alias("rb"))


@query("SELECT ep, f, ca, cb FROM mk")
def closed_mask(spark, d):
    return fr.masked(spark, d).select("ep", "f", "ca", "cb")


@query("SELECT ep, f, ga < ra - 0.45 AS closed FROM mk")
def closed_mask_onesided(spark, d):
    return fr.masked(spark, d).select("ep", "f", (C("ga") < C("ra") - 0.45).alias("closed"))


@query("SELECT ep, on_ AS \"on\", first, last, last - first + 1 AS len FROM ra_")
def mask_runs(spark, d):
    return runs.runs(fr.masked(spark, d), "ca")


@query("SELECT ep, f, closed FROM fa_")
def close_gaps(spark, d):
    return runs.close_gaps(fr.masked(spark, d), "ca", 3).select("ep", "f", C("ca").alias("closed"))


@query("SELECT ep, s, e FROM ha")
def longest_run(spark, d):
    return fr.hold(spark, d, "a")


@query("SELECT ep, e1, e2, f1, f2, no_tube, no_pestle FROM cq")
def hold_window(spark, d):
    """The tube's hold in the first part of the episode, and the pestle's after it; shares where there is none."""
    flag = lambda x: F.array_contains("flags", x)
    return fr.segmented(spark, d).select("ep", "e1", "e2", "f1", "f2", flag("no_tube").alias("no_tube"), flag("no_pestle").alias("no_pestle"))


@query("SELECT ep, e1, e2, onset FROM cq")
def low_drift_onset(spark, d):
    return fr.segmented(spark, d).select("ep", "e1", "e2", "onset")


@query("SELECT ep, gs AS s, ge AS e FROM cq")
def active_window(spark, d):
    return fr.segmented(spark, d).select("ep", "s", "e")


@query("SELECT ep, n, array_to_string(pts, ',') AS points, array_to_string(list_filter([CASE WHEN no_tube THEN 'no_tube' END, CASE WHEN no_pestle THEN 'no_pestle' END, CASE WHEN no_grind THEN 'no_grind' END, CASE WHEN no_order THEN 'order' END], lambda x: x IS NOT NULL), '|') AS flags FROM cq")
def segment_episode(spark, d):
    return fr.segmented(spark, d).select("ep", "n", F.array_join("cps", ",").alias("points"), F.array_join("flags", "|").alias("flags"))


@query(f"SELECT ep, array_to_string(CASE WHEN no_order THEN [{EGO_FALLBACK}] ELSE raw END, ',') AS points, CASE WHEN is_left THEN 'left' ELSE 'right' END AS holder, array_to_string(list_filter([CASE WHEN le - ls < 3 THEN 'no_left' END, CASE WHEN re - rs < 3 THEN 'no_right' END, CASE WHEN no_wipe THEN 'no_wipe' END, CASE WHEN no_order THEN 'order' END], lambda x: x IS NOT NULL), '|') AS flags FROM eg")
def segment_wipe(spark, d):
    return fr.wiped(spark, d).select("ep", F.array_join("cps", ",").alias("points"), "holder", F.array_join("flags", "|").alias("flags"))


@query("SELECT ep, cs AS low, ce AS high, CASE WHEN no_wipe THEN cs + CAST(floor(0.25::DOUBLE * (ce - cs)) AS BIGINT) ELSE cs + ws END AS start, no_wipe FROM (SELECT ep, no_wipe, CASE WHEN no_order THEN NULL ELSE cs END AS cs, CASE WHEN no_order THEN NULL ELSE ce END AS ce, ws FROM eg)")
def wipe_onset(spark, d):
    """Null where the points are out of order."""
    found = lambda k: F.when(~F.array_contains("flags", "order"), C("cps")[k])
    return fr.wiped(spark, d).select("ep", found(1).alias("low"), found(3).alias("high"), found(2).alias("start"), F.array_contains("flags", "no_wipe").alias("no_wipe"))


@query("SELECT a.ep, CASE WHEN a.e - a.s >= b.e - b.s THEN 'left' ELSE 'right' END AS holder, CASE WHEN a.e - a.s >= b.e - b.s THEN 'right' ELSE 'left' END AS wiper FROM ha a JOIN hb b USING (ep)")
def role_assign(spark, d):
    a = fr.hold(spark, d, "a").select("ep", (C("e") - C("s")).alias("l"))
    b = fr.hold(spark, d, "b").select("ep", (C("e") - C("s")).alias("r"))
    left = C("l") >= C("r")
    return a.join(b, "ep").select("ep", F.when(left, "left").otherwise("right").alias("holder"), F.when(left, "right").otherwise("left").alias("wiper"))


@query("SELECT ep, i, c, n FROM st")
def critical_points(spark, d):
    return fr.state_points(spark, d)


_LOOSE = "SELECT ep, i, least(greatest(c, 1), n - 2) AS c, c AS raw, n FROM vl"


@query(f"SELECT ep, i, least(i + max(c - i) OVER (PARTITION BY ep ORDER BY i ROWS UNBOUNDED PRECEDING), n - 2 - (6 - i)) AS c FROM ({_LOOSE})")
def order_repair(spark, d):
    return fr.other_points(spark, d).select("ep", "i", intervals.repair(6).alias("c"))


@query("SELECT ep, i, i + max(c - i) OVER (PARTITION BY ep ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM vl")
def order_repair_fwd(spark, d):
    return fr.other_points(spark, d).select("ep", "i", intervals.repair_forward().alias("c"))


@query("SELECT ep, k, first, last, last - first + 1 AS n_frames, round(first / 30.0, 2) AS start_t, round(last / 30.0, 2) AS end_t FROM sub")
def subtasks(spark, d):
    parts = intervals.subtasks(fr.state_points(spark, d))
    return parts.select("ep", "k", "first", "last", (C("last") - C("first") + 1).alias("n_frames"), F.round(C("first") / 30.0, 2).alias("start_t"), F.round(C("last") / 30.0, 2).alias("end_t"))


@query("SELECT ep, k, CASE WHEN k = 0 THEN first ELSE first + 1 END AS first, greatest(CASE WHEN k = 0 THEN first ELSE first + 1 END, CASE WHEN last = n - 1 THEN last ELSE last + 1 END) AS last FROM sub")
def stages_alt(spark, d):
    return intervals.stages(fr.state_points(spark, d)).select("ep", "k", "first", "last")


@query("SELECT ep, unnest(range(first, last + 1)) AS f, k FROM sub WHERE last >= first")
def dense_index(spark, d):
    return intervals.dense(intervals.subtasks(fr.state_points(spark, d)))


@query("SELECT fr.ep, k, count(*) AS frames, sum(a) AS sum_a, max(b) AS max_b FROM fr JOIN sub ON fr.ep = sub.ep AND f BETWEEN first AND last GROUP BY fr.ep, k")
def frame_in_interval(spark, d):
    index = intervals.dense(intervals.subtasks(fr.state_points(spark, d)))
    return fr.frames(spark, d).join(index, ["ep", "f"]).groupBy("ep", "k").agg(F.count(F.lit(1)).alias("frames"), F.sum("a").alias("sum_a"), F.max("b").alias("max_b"))


@query("SELECT ep, i, c, d, source, review FROM fu")
def fuse_points(spark, d):
    return _fused(spark, d).select("ep", "i", "c", "d", "source", "review")


def _fused(spark, d):
    return fusion.fused(fr.state_points(spark, d), fr.other_points(spark, d), 4, [2, 5])


@query("SELECT st.ep, st.i, CASE WHEN st.i IN (3) AND vl.c IS NOT NULL THEN vl.c ELSE st.c END AS c, coalesce(abs(vl.c - st.c) > 6.5, true) AS review, st.i - 1 AS review_id FROM st LEFT JOIN vl USING (ep, i)")
def fuse_points_ego(spark, d):
    rows = fusion.fused(fr.state_points(spark, d), fr.other_points(spark, d), 6.5, [3], fall_back=False)
    return rows.select("ep", "i", "c", "review", (C("i") - 1).alias("review_id"))


@query("SELECT st.ep, CAST(CASE WHEN abs(st.c - vl.c) <= 4 THEN round_even((st.c + vl.c) / 2.0, 0) ELSE coalesce(vl.c, st.c) END AS BIGINT) AS c, CASE WHEN abs(st.c - vl.c) <= 4 THEN 'pose+vision' WHEN vl.c IS NOT NULL THEN 'vision(review)' ELSE 'pose' END AS source FROM st LEFT JOIN vl USING (ep, i) WHERE st.i = 3")
def merge_onsets(spark, d):
    pose = fr.state_points(spark, d).where("i = 3").select("ep", C("c").alias("pose"))
    vision = fr.other_points(spark, d).where("i = 3").select("ep", C("c").alias("vision"))
    frame, source = fusion.merged_onset(C("pose"), C("vision"), 4)
    return pose.join(vision, "ep", "left").select("ep", frame.alias("c"), source.alias("source"))


@query("SELECT ep, count(*) FILTER (review) AS n_review, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (review) AS points FROM fu GROUP BY ep")
def review_queue(spark, d):
    points = F.array_join(F.array_sort(F.collect_list(F.when(C("review"), C("i")))), ",")
    return _fused(spark, d).groupBy("ep").agg(F.count_if("review").alias("n_review"), F.when(F.count_if("review") > 0, points).alias("points"))


@query("SELECT i, round(avg(d), 6) AS mean_d, count(d) AS episodes FROM fu GROUP BY i")
def disagreement_by_point(spark, d):
    return _fused(spark, d).groupBy("i").agg(F.round(F.avg("d"), 6).alias("mean_d"), F.count("d").alias("episodes"))


@query("SELECT st.ep, st.i, coalesce(vl.c, st.c) AS c, CASE WHEN vl.c IS NOT NULL THEN 'human' ELSE 'state' END AS source FROM st LEFT JOIN vl USING (ep, i)")
def seed_priority(spark, d):
    other = fr.other_points(spark, d).select("ep", "i", C("c").alias("v"))
    joined = fr.state_points(spark, d).join(other, ["ep", "i"], "left")
    return joined.select("ep", "i", F.coalesce("v", "c").alias("c"), F.when(C("v").isNotNull(), "human").otherwise("state").alias("source"))


@query("SELECT ep, i, c, lo, hi FROM cw")
def candidate_window(spark, d):
    return _windows(spark, d).select("ep", "i", "c", "lo", "hi")


def _windows(spark, d, half: int = 10):
    rows = fr.state_points(spark, d)
    before, after = F.lag("c").over(intervals.by_point()), F.lead("c").over(intervals.by_point())
    low = F.greatest(C("c") - half, F.coalesce(before + 1, F.lit(0)))
    high = F.least(C("c") + half, F.coalesce(after - 1, C("n") - 1))
    rows = rows.withColumns({"lo": low, "hi": high})
    bad = C("hi") <= C("lo")
    low, high = F.when(bad, F.greatest(F.lit(0), C("c") - half // 2)).otherwise(C("lo")), F.when(bad, F.least(C("n") - 1, C("c") + half // 2)).otherwise(C("hi"))
    return rows.withColumns({"lo": low.cast("long"), "hi": high.cast("long")})


@query("SELECT ep, i, array_to_string(cand, ',') AS frames FROM cf")
def candidate_frames(spark, d):
    return _candidates(spark, d).select("ep", "i", F.array_join("cand", ",").alias("frames"))


def _candidates(spark, d):
    some = F.array_sort(F.array_union(fusion.spaced(C("lo"), C("hi"), 7), F.array("c")))
    return _windows(spark, d).withColumn("cand", some)


@query("SELECT cf.ep, cf.i, vl.c AS asked, list_sort(list_transform(cand, lambda x: [abs(x - vl.c), x]))[1][2] AS chosen FROM cf JOIN vl USING (ep, i)")
def nearest_candidate(spark, d):
    asked = fr.other_points(spark, d).select("ep", "i", C("c").alias("asked"))
    return _candidates(spark, d).join(asked, ["ep", "i"]).select("ep", "i", "asked", fusion.nearest_of(C("cand"), C("asked")).alias("chosen"))


@query("SELECT ep, i, delta, conf, decision FROM mv")
def move_decision(spark, d):
    return _moves(spark, d).select("ep", "i", "delta", "conf", "decision")


def _moves(spark, d):
    state = fr.state_points(spark, d).select("ep", "i", C("c").alias("s"))
    rows = fr.other_points(spark, d).join(state, ["ep", "i"]).withColumn("delta", C("c") - C("s"))
    said = F.when((C("ep") + C("i")) % 5 == 0, "Low").when((C("ep") + C("i")) % 5 == 1, "Medium-ish").otherwise("very HIGH")
    rows = rows.withColumn("conf", fusion.confidence(said))
    evidence = F.when((C("ep") + C("i")) % 4 == 0, "  ").otherwise("tube visible")
    return rows.withColumn("decision", fusion.decision(C("conf"), C("delta"), evidence, C("i"), 8, 2))


@query("SELECT ep, count(*) FILTER (decision = 'accepted') AS moved, count(*) FILTER (conf = 'high') AS high_conf, max(abs(delta)) AS max_abs_delta FROM mv GROUP BY ep")
def verify_summary(spark, d):
    return _moves(spark, d).groupBy("ep").agg(F.count_if(C("decision") == "accepted").alias("moved"), F.count_if(C("conf") == "high").alias("high_conf"), F.max(F.abs("delta")).alias("max_abs_delta"))


def _replied(spark, d):
    """Replies built around the events' JSON: bare, fenced, in prose, broken, or none."""
    raw = (
        F.when(C("event_id") % 5 == 0, F.concat(F.lit("```json\n"), C("props"), F.lit("\n```")))
        .when(C("event_id") % 5 == 1, F.concat(F.lit("Sure: "), C("props"), F.lit(" done")))
        .when(C("event_id") % 5 == 2, F.concat(F.lit("list ["), C("props"), F.lit("]")))
        .when(C("event_id") % 5 == 3, F.concat(F.lit("{oops "), C("props")))
        .otherwise(F.lit("no json"))
    )
    return fr.events(spark, d).select("event_id", "event_type", raw.alias("raw"))


_REPLY_K = "CASE WHEN event_id % 5 IN (0, 1, 2) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END"


@query(f"SELECT event_id, {_REPLY_K} AS k, event_id % 5 IN (0, 1, 2) AS parsed FROM events")
def extract_json(spark, d):
    found = replies.json_in(C("raw"))
    k = F.get_json_object(found, "$.k").cast("long")
    return _replied(spark, d).select("event_id", k.alias("k"), (found != "{}").alias("parsed"))


_FORMS = ("```json\\n[{\"stages\": [%d]}]\\n```", "Sure: [{\"name\": \"a\", \"k\": %d}] so", "x [{\"k\": %d}, {\"k\": 2}] y", "[{\"k\": %d}, 5]", "{\"k\": %d}", "%d", "{oops {\"k\": %d}", "[%d]")


@query("""rp AS (SELECT event_id, event_id % 8 AS form, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, form NOT IN (2, 6) OR form = 2 AS parsed, CASE form WHEN 0 THEN '{"stages":[' || k || ']}' WHEN 1 THEN '{"k":' || k || ',"name":"a"}' WHEN 2 THEN '{"stages":[{"k":' || k || '},{"k":2}]}' WHEN 4 THEN '{"k":' || k || '}' END AS object,
form NOT IN (2, 6) AS object_parsed FROM rp""")
def reply_shapes(spark, d):
    """What replies hold: objects before lists, a list of one object in prose as that object, other lists as their stages."""
    k = F.get_json_object("props", "$.k").cast("long")
    raw = F.lit(None).cast("string")
    for form, text in enumerate(_FORMS):
        raw = F.when(C("event_id") % 8 == form, F.format_string(text, k)).otherwise(raw)
    # One struct for all columns: of each alone Spark would parse the reply again.
    flat = lambda found: F.to_json(F.try_parse_json(replies.shaped(found)))
    seen = lambda v: F.struct(v["any"].isNotNull().alias("parsed"), flat(v["any"]).alias("object"), v["object"].isNotNull().alias("object_parsed"))
    return fr.events(spark, d).select("event_id", raw.alias("raw")).select("event_id", let(replies.json_values(C("raw")), seen).alias("seen")).select("event_id", "seen.*")


@query(f"SELECT event_id, event_id % 5 = 2 AS is_list, {_REPLY_K} AS k FROM events")
def extract_json_list(spark, d):
    """Of the replies those that speak of a list; the object in it counts before the list."""
    found = replies.json_value(C("raw"), lists=True)
    k = F.get_json_object(replies.shaped(found), "$.k").cast("long")
    return _replied(spark, d).select("event_id", C("raw").startswith("list [").alias("is_list"), k.alias("k"))


@query("SELECT name, CASE WHEN name IN ('lift', 'move', 'moving', 'carry') THEN 'transport' WHEN name = 'open' THEN 'release' WHEN name IN ('finish', 'complete') THEN 'done' WHEN name IN ('reach', 'transport', 'place', 'release', 'grasp', 'adjust', 'done', 'global') THEN name ELSE 'adjust' END AS stage, count(*) AS rows FROM (SELECT ['lift', 'open', 'reach', 'carry', 'grasp', 'weird', 'complete', 'done', 'global', 'moving'][1 + event_id % 10] AS name FROM events) GROUP BY ALL")
def stage_name_map(spark, d):
    names = F.array(*(F.lit(x) for x in ("lift", "open", "reach", "carry", "grasp", "weird", "complete", "done", "global", "moving")))
    raw = names[(C("event_id") % 10).cast("int")]
    rows = fr.events(spark, d).select(raw.alias("name"), replies.stage_name(F.concat(F.lit(" "), F.upper(raw))).alias("stage"))
    return rows.groupBy("name", "stage").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT ep, i, start, \"end\" FROM ns")
def normalize_stages(spark, d):
    return intervals.normalised(fr.proposed_stages(spark, d)).select("ep", "i", "start", "end")


@query("SELECT ep, bool_and(ok) AND arg_max(last, i) = max(n) - 1 AS covered, count(*) AS parts FROM (SELECT *, first = coalesce(lag(last) OVER (PARTITION BY ep ORDER BY i), -1) + 1 AND last >= first AND last < n AS ok FROM pr) GROUP BY ep")
def validate_coverage(spark, d):
    return intervals.coverage(fr.proposed_stages(spark, d))


@query("SELECT ep, score FROM sc")
def interval_score(spark, d):
    return intervals.interval_score(fr.proposed_stages(spark, d))


_EDGE = """SELECT sub.ep, k, ['reach', 'transport', 'place', 'release', 'grasp', 'adjust', 'done'][k + 1] AS stage, arg_max(b, f) - arg_min(b, f) AS d, max(b) - min(b) AS spread, max(w) AS w
FROM sub JOIN (SELECT *, max(b) OVER (PARTITION BY ep) - min(b) OVER (PARTITION BY ep) AS w FROM fr) x ON x.ep = sub.ep AND f BETWEEN first AND last GROUP BY sub.ep, k"""
_EDGE_SCORE = f"""SELECT ep, k, stage, CASE WHEN stage = 'grasp' THEN CASE WHEN -d > 0.3 * w THEN 1.0 WHEN -d > 0.1 * w THEN 0.7 WHEN abs(d) <= 0.1 * w THEN 0.4 ELSE 0.0 END
WHEN stage = 'release' THEN CASE WHEN d > 0.3 * w THEN 1.0 WHEN d > 0.1 * w THEN 0.7 WHEN abs(d) <= 0.1 * w THEN 0.4 ELSE 0.0 END
WHEN stage = 'transport' THEN CASE WHEN spread / w <= 0.1 THEN 1.0 WHEN spread / w <= 0.2 THEN 0.7 WHEN spread / w <= 0.4 THEN 0.4 ELSE 0.0 END
WHEN stage IN ('reach', 'done') THEN CASE WHEN spread / w <= 0.1 THEN 1.0 ELSE 0.7 END ELSE 0.7 END::DOUBLE AS score FROM ({_EDGE})"""


@query(_EDGE_SCORE)
def boundary_score(spark, d):
    return _edges(spark, d)


def _edges(spark, d, points=None):
    index = intervals.dense(intervals.subtasks(points or fr.state_points(spark, d)))
    rows = fr.frames(spark, d).withColumn("w", (F.max("b").over(P()) - F.min("b").over(P())).cast("double"))
    rows = rows.join(index, ["ep", "f"]).groupBy("ep", "k").agg((F.max_by("b", "f") - F.min_by("b", "f")).alias("d"), (F.max("b") - F.min("b")).alias("spread"), F.max("w").alias("w"))
    stage = F.array(*map(F.lit, fr.STAGE_OF))[C("k").cast("int")]
    return rows.select("ep", "k", stage.alias("stage"), quality.boundary(stage, C("d"), C("spread"), C("w")).alias("score"))


@query("SELECT ep, k, array_to_string(list_sort(list_distinct([first, (first + last) // 2, last, least(last + 5, n - 1)])), ',') AS frames FROM sub WHERE last >= first")
def self_check_samples(spark, d):
    parts = intervals.subtasks(fr.state_points(spark, d)).where("last >= first")
    middle = F.floor((C("first") + C("last")) / 2)
    some = F.array_sort(F.array_distinct(F.array("first", middle, C("last"), F.least(C("last") + 5, C("n") - 1))))
    return parts.select("ep", "k", F.array_join(some, ",").alias("frames"))


@query(f"SELECT sc.ep, floor((3 * CAST(round(sc.score * 10000) AS BIGINT) + 3 * CAST(round(e.score * 10000) AS BIGINT) + 4 * CASE WHEN sc.ep % 3 <> 0 THEN 5000 ELSE 0 END + 5) / 10.0) / 10000 AS quality FROM sc JOIN (SELECT ep, round(avg(score), 4) AS score FROM ({_EDGE_SCORE}) GROUP BY ep) e USING (ep)")
def quality_rollup(spark, d):
    points = fr.points_once(spark, d)
    edges = _edges(spark, d, points).groupBy("ep").agg(F.round(F.avg("score"), 4).alias("edges"))
    rows = intervals.interval_score(fr.proposed_stages(spark, d, points)).join(edges, "ep")
    future = F.when(C("ep") % 3 != 0, 0.5)
    return rows.select("ep", quality.rolled_up(C("score"), C("edges"), future).alias("quality"))


@query("SELECT ep, k FROM sub WHERE NOT (ep % 2 = 0 AND k < 4)")
def resume_antijoin(spark, d):
    samples = intervals.subtasks(fr.state_points(spark, d)).select("ep", "k")
    log = samples.where("ep % 2 = 0").select("ep", "k", F.when(C("k") < 4, 1.0).alias("score"))
    return quality.to_do(samples, log, ["ep", "k"])


@query("SELECT ep, array_to_string(list_sort(list_distinct(list(least(greatest(c + (ep % 3) * 20, 0), n - 1)))), ',') AS keyframes, count(*) FILTER (c + (ep % 3) * 20 > n - 1) AS clipped FROM st WHERE i IN (2, 3, 5, 6) GROUP BY ep")
def keyframe_export(spark, d):
    return _keyframes(spark, d).select("ep", F.array_join("keyframes", ",").alias("keyframes"), "clipped")


def _keyframes(spark, d):
    asked = C("c") + (C("ep") % 3) * 20
    kept = F.least(F.greatest(asked, F.lit(0)), C("n") - 1)
    points = fr.state_points(spark, d).where(C("i").isin(2, 3, 5, 6))
    return points.groupBy("ep").agg(F.array_sort(F.array_distinct(F.collect_list(kept))).alias("keyframes"), F.count_if(asked > C("n") - 1).alias("clipped"))


@query("SELECT count(*) AS episodes, count(*) FILTER (clipped > 0) AS with_warnings, sum(clipped) AS warnings FROM (SELECT ep, count(*) FILTER (c + (ep % 3) * 20 > n - 1) AS clipped FROM st WHERE i IN (2, 3, 5, 6) GROUP BY ep)")
def keyframe_summary(spark, d):
    return _keyframes(spark, d).agg(F.count(F.lit(1)).alias("episodes"), F.count_if(C("clipped") > 0).alias("with_warnings"), F.sum("clipped").alias("warnings"))


def _clocks(spark, d):
    rows = fr.frames(spark, d)
    t = C("us") - F.min("us").over(P())
    rows = rows.withColumn("t", t)
    left = rows.where("kind = 'click'").select("ep", "t", C("f").alias("id"))
    return left, rows.where("kind = 'view'").select("ep", "t", C("a").alias("v"))


_NEAR = """SELECT l.ep, l.id, l.t, arg_max(r.t, r.t) FILTER (r.t <= l.t) AS pt, arg_max(r.v, r.t) FILTER (r.t <= l.t) AS pv, arg_min(r.t, r.t) FILTER (r.t >= l.t) AS nt, arg_min(r.v, r.t) FILTER (r.t >= l.t) AS nv
FROM (SELECT ep, f AS id, t FROM ck WHERE kind = 'click') l LEFT JOIN (SELECT ep, t, a AS v FROM ck WHERE kind = 'view') r ON l.ep = r.ep GROUP BY ALL"""


@query(f"SELECT ep, id, t, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR nt = pt THEN pv ELSE pv + (nv - pv) * CAST(t - pt AS DOUBLE) / (nt - pt) END, 4) AS v FROM ({_NEAR})")
def interp_align(spark, d):
    found = align.interpolated(*_clocks(spark, d))
    return found.select("ep", "id", "t", F.round("v", 4).alias("v"))


@query(f"SELECT ep, id, t, CASE WHEN pt IS NULL OR nt - t < t - pt THEN nt ELSE pt END AS rt, CAST(CASE WHEN pt IS NULL OR nt - t < t - pt THEN nv ELSE pv END AS DOUBLE) AS v FROM ({_NEAR})")
def nearest_align(spark, d):
    return align.nearest(*_clocks(spark, d))


@query("SELECT ep, id, least(CAST(round_even(id * (m - 1.0) / (n - 1), 0) AS BIGINT), m - 1) AS at FROM (SELECT ep, f AS id, n, count(*) FILTER (kind = 'view') OVER (PARTITION BY ep) AS m FROM fr) WHERE m > 0 AND n > 1")
def proportional_align(spark, d):
    rows = fr.frames(spark, d).withColumn("m", F.count(F.when(C("kind") == "view", 1)).over(P())).where("m > 0 AND n > 1")
    at = F.bround(C("f") * (C("m") - 1.0) / (C("n") - 1), 0).cast("long")
    return rows.select("ep", C("f").alias("id"), F.least(at, C("m") - 1).alias("at"))


@query("SELECT ep, f, t FROM ck")
def elapsed_clock(spark, d):
    return fr.frames(spark, d).select("ep", "f", (C("us") - F.min("us").over(P())).alias("t"))


@query("SELECT ep, round((count(*) - 1) * 1000000.0 / nullif(max(us) - min(us), 0), 9) AS fps FROM fr GROUP BY ep")
def fps_estimate(spark, d):
    span = F.nullif(F.max("us") - F.min("us"), F.lit(0).cast("long"))
    return fr.frames(spark, d).groupBy("ep").agg(F.round((F.count(F.lit(1)) - 1) * 1000000.0 / span, 9).alias("fps"))


def _energy(spark, d):
    """Mean absolute difference of consecutive vectors of a label, as whole numbers of 1e-4."""
    order = Window.partitionBy("label").orderBy("vec_id")
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long"))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(C("label").cast("long").alias("ep"), "vec_id", (F.row_number().over(order) - 1).cast("long").alias("f"), whole.alias("v"))
    gap = F.aggregate(F.zip_with("v", F.lag("v").over(W()), lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("ep", "f", F.coalesce(gap, F.lit(0).cast("long")).alias("energy"))


@query("SELECT ep, f, energy FROM en")
def frame_diff_energy(spark, d):
    return _energy(spark, d)


@query("SELECT ep, s, e FROM hen")
def vision_onset(spark, d):
    limit = F.min("energy").over(P()) + 0.5 * (F.round(F.percentile("energy", F.lit(0.9)).over(P()), 4) - F.min("energy").over(P()))
    rows = _energy(spark, d).withColumn("on", C("energy") > limit)
    return runs.longest_run(runs.close_gaps(rows.select("ep", "f", "on"), "on", 2), "on")


@query("SELECT ep, k, CAST(floor(100 + first * 1000.0 / n) AS BIGINT) AS x0, greatest(CAST(floor(100 + (last + 1) * 1000.0 / n) AS BIGINT), CAST(floor(100 + first * 1000.0 / n) AS BIGINT) + 1) AS x1 FROM sub")
def timeline_geometry(spark, d):
    x0 = F.floor(100 + C("first") * 1000.0 / C("n"))
    x1 = F.floor(100 + (C("last") + 1) * 1000.0 / C("n"))
    return intervals.subtasks(fr.state_points(spark, d)).select("ep", "k", x0.alias("x0"), F.greatest(x1, x0 + 1).alias("x1"))


@query("SELECT ep, list(c ORDER BY i) = list_sort(list(c)) AS ordered FROM vl GROUP BY ep")
def human_save_check(spark, d):
    cs = F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"])
    return fr.other_points(spark, d).groupBy("ep").agg(cs.alias("cs")).select("ep", (C("cs") == F.array_sort("cs")).alias("ordered"))


@query("SELECT ep, count(*) AS n FROM fr WHERE ep IN (1, 3, 5, 6, 7, 12) GROUP BY ep")
def episode_subset(spark, d):
    from episodica.sources.episodes import subset

    return fr.frames(spark, d).where(C("ep").isin(subset("3,5-7,x,12,1,5"))).groupBy("ep").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.event_id, coalesce(n.n_name, 'task_index_' || (e.user_id % 30)) AS task FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 30")
def task_lookup(spark, d):
    tasks = spark.read.parquet(f"{d}/nation.parquet").select(C("n_nationkey").alias("key"), "n_name")
    rows = fr.events(spark, d).withColumn("key", C("user_id") % 30).join(tasks, "key", "left")
    return rows.select("event_id", F.coalesce("n_name", F.concat(F.lit("task_index_"), C("key"))).alias("task"))


@query("SELECT vec_id, CAST(embedding[4] AS DOUBLE) AS dim3, len(embedding) - 4 AS kept, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)))) AS BIGINT) - CAST(round(CAST(embedding[4] AS DOUBLE) * 10000) AS BIGINT) - CAST(round(CAST(embedding[5] AS DOUBLE) * 10000) AS BIGINT) - CAST(round(CAST(embedding[14] AS DOUBLE) * 10000) AS BIGINT) - CAST(round(CAST(embedding[15] AS DOUBLE) * 10000) AS BIGINT) AS total FROM embeddings")
def state_array_ops(spark, d):
    kept = F.filter("embedding", lambda _, i: ~i.isin(3, 4, 13, 14))
    whole = F.transform(kept, lambda x: F.round(x.cast("double") * 10000).cast("long"))
    total = F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select("vec_id", C("embedding")[3].cast("double").alias("dim3"), F.size(kept).cast("long").alias("kept"), total.alias("total"))


@query("SELECT user_id AS ep, arg_max(event_type, event_id) AS last_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_row_wins(spark, d):
    rows = fr.events(spark, d).select(C("user_id").alias("ep"), C("event_type").alias("last_type"), "event_id")
    return quality.last_row(rows, "ep", "event_id")


@query("SELECT event_id, 'data:image/jpeg;base64,' || base64(encode(props)) AS url FROM events")
def base64_url(spark, d):
    return fr.events(spark, d).select("event_id", replies.data_url(C("props").cast("binary")).alias("url"))


@query("SELECT ep, i, 'Point p' || i || ' of episode ' || ep || ': choose among ' || array_to_string(cand, ', ') || ' of ' || n || ' frames.' AS prompt FROM cf")
def prompt_text(spark, d):
    text = F.format_string("Point p%d of episode %d: choose among %s of %d frames.", "i", "ep", F.array_join("cand", ", "), "n")
    return _candidates(spark, d).select("ep", "i", text.alias("prompt"))


def _named(spark, d):
    """Proposed stages as replies give them: names in odd forms, times that are missing or no numbers, episodes without stages."""
    name = F.array(*(F.lit(x) for x in ("Reach", "lift", "place", None, "grasp", "odd", "done")))[(C("i") - 1).cast("int")]
    rows = fr.proposed_stages(spark, d)
    some = rows.where("ep % 8 <> 0").withColumn("i", F.row_number().over(Window.partitionBy("ep").orderBy("i")).cast("long")).withColumn("name", name)
    field = lambda c, gone: F.when(~gone, F.to_json(F.struct(F.concat(C(c), F.lit("")).alias("v"))))  # noqa: E731  a text that holds a number
    start, end = field("first", (C("ep") + C("i")) % 9 == 0), field("last", (C("ep") + C("i")) % 7 == 0)
    start = F.when((C("ep") + 2 * C("i")) % 11 == 0, '{"v": "soon"}').when(C("i") % 2 == 0, F.regexp_replace(start, r':"(-?\d+)"', ":$1.9")).otherwise(start)
    parsed = {c: replies.whole_number(F.try_variant_get(F.parse_json(x), "$.v", "variant")) for c, x in (("first", start), ("last", end))}
    some = some.withColumns({"first": parsed["first"][0], "last": parsed["last"][0], "bad": parsed["first"][1] | parsed["last"][1]})
    some = some.withColumn("stage", replies.stage_name(F.coalesce("name", F.lit("adjust"))))
    none = rows.where("ep % 8 = 0").groupBy("ep").agg(F.max("n").alias("n"))
    return some.unionByName(none, allowMissingColumns=True)


@query("""nm0 AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY i) AS i, first, last, n FROM pr WHERE ep % 8 <> 0),
nm1 AS (SELECT ep, i, ['Reach', 'lift', 'place', NULL, 'grasp', 'odd', 'done'][i] AS name, ['reach', 'transport', 'place', 'adjust', 'grasp', 'adjust', 'done'][i] AS stage, (ep + 2 * i) % 11 = 0 AS bad,
  CASE WHEN (ep + i) % 9 = 0 THEN NULL ELSE first END AS a, CASE WHEN (ep + i) % 7 = 0 THEN NULL ELSE last END AS b, n, count(*) OVER (PARTITION BY ep) AS m FROM nm0),
fold AS (SELECT ep, 0::BIGINT AS i, -1::BIGINT AS e, '' AS line, false AS changed, 0::BIGINT AS renamed, 0::BIGINT AS kept, false AS stop FROM nm1 GROUP BY ep
  UNION ALL SELECT ep, i, e2, CASE WHEN stop THEN line ELSE line || stage || ':' || s || '-' || e2 || CASE WHEN name <> stage THEN '(' || name || ')' ELSE '' END || ';' END,
    changed OR name IS DISTINCT FROM stage OR bad OR rs <> s OR stop OR (i = m AND re <> n - 1), renamed + (name IS DISTINCT FROM stage)::INT, kept + (NOT stop)::INT, stop FROM
  (SELECT fold.ep, nm1.i, n, m, bad, name, stage, e + 1 AS s, e + 1 >= n AS stop, line, changed, renamed, kept, CASE WHEN bad THEN e + 1 ELSE coalesce(a, e + 1) END AS rs, CASE WHEN bad THEN e + 1 ELSE coalesce(b, a, e + 1) END AS re,
    CASE WHEN nm1.i = m THEN greatest(e + 1, n - 1) ELSE greatest(e + 1, least(CASE WHEN bad THEN e + 1 ELSE coalesce(b, a, e + 1) END, n - 1)) END AS e2
  FROM fold JOIN nm1 ON nm1.ep = fold.ep AND nm1.i = fold.i + 1 WHERE NOT fold.stop)),
done AS (SELECT ep, arg_max(line, i) AS line, arg_max(changed, i) AS changed, arg_max(renamed, i) AS renamed, arg_max(kept, i) AS kept FROM fold GROUP BY ep)
SELECT ep, line AS stages, changed, renamed, kept AS stage_count, true AS coverage_ok FROM done UNION ALL SELECT ep, 'global:0-' || (max(n) - 1) || ';', true, 0, 1, true FROM pr WHERE ep % 8 = 0 GROUP BY ep""")
def normalized_records(spark, d):
    rows = intervals.normalised_stages(_named(spark, d))
    line = lambda s: F.concat(s["name"], F.lit(":"), s["start"], F.lit("-"), s["end"], F.coalesce(F.concat(F.lit("("), s["original"], F.lit(")")), F.lit("")), F.lit(";"))
    return rows.select("ep", F.array_join(F.transform("stages", line), "").alias("stages"), "changed", "renamed", "stage_count", "coverage_ok")


def _points(rows):
    return rows.groupBy("ep").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("points"))


_TRACKS = "hu AS (SELECT ep, list(c ORDER BY i) AS pts FROM vl WHERE ep % 3 = 0 AND NOT (ep % 2 = 0 AND i = 6) GROUP BY ep), fz AS (SELECT ep, list(c ORDER BY i) AS pts FROM fu WHERE ep % 5 <> 0 GROUP BY ep), ss AS (SELECT ep, list(c ORDER BY i) AS pts FROM st GROUP BY ep)"


def _tracks(spark, d):
    human = fr.other_points(spark, d).where("ep % 3 = 0 AND NOT (ep % 2 = 0 AND i = 6)")
    return {"human": _points(human), "fused": _points(_fused(spark, d).where("ep % 5 <> 0")), "state": _points(fr.state_points(spark, d))}


@query(f"{_TRACKS} SELECT ss.ep, CASE WHEN len(hu.pts) = 6 THEN 'human' WHEN len(fz.pts) = 6 THEN 'fused' ELSE 'state' END AS source, array_to_string(CASE WHEN len(hu.pts) = 6 THEN hu.pts WHEN len(fz.pts) = 6 THEN fz.pts ELSE ss.pts END, ',') AS points FROM ss LEFT JOIN fz USING (ep) LEFT JOIN hu USING (ep)")
def first_track(spark, d):
    """The annotation that a reviewer starts from: human, else fused, else state, whichever has all six points."""
    return fusion.first_of(_tracks(spark, d)).select("ep", "source", F.array_join("points", ",").alias("points"))


@query(f"{_TRACKS} SELECT ss.ep, CASE WHEN ss.ep % 4 <> 0 THEN 'state' WHEN len(ot.pts) = 6 THEN 'other' WHEN len(fz.pts) = 6 THEN 'fused' END AS source, array_to_string(CASE WHEN ss.ep % 4 <> 0 THEN ss.pts WHEN len(ot.pts) = 6 THEN ot.pts WHEN len(fz.pts) = 6 THEN fz.pts END, ',') AS points FROM ss LEFT JOIN fz USING (ep) LEFT JOIN (SELECT ep, list(c ORDER BY i) AS pts FROM vl GROUP BY ep) ot USING (ep) WHERE ss.ep % 4 <> 0 OR ot.pts IS NOT NULL OR fz.pts IS NOT NULL")
def base_track(spark, d):
    """The track that all others are drawn against: state, else the model's, else the fused one."""
    state = _points(fr.state_points(spark, d).where("ep % 4 <> 0"))
    tracks = {"state": state, "other": _points(fr.other_points(spark, d)), "fused": _tracks(spark, d)["fused"]}
    return fusion.first_of(tracks).select("ep", "source", F.array_join("points", ",").alias("points"))


def _exported(spark, d):
    episodes = fr.frames(spark, d).groupBy(C("ep").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    episodes = episodes.select((C("of") - 2).alias("episode_index"), F.when(C("of") % 6 != 0, C("n") - 20).alias("length"), F.concat(F.lit("e"), C("of")).alias("name"))
    annotations = _points(fr.state_points(spark, d)).where("ep % 5 <> 0").withColumn("names", F.when(C("ep") % 2 == 0, F.array(F.lit("a"), F.lit("b"))))
    return export.exported(episodes, annotations, "eventvla4", offset=2)


_EXPORT = """ex AS (SELECT st.ep, st.ep - 2 AS episode_index, 'e' || st.ep AS name, CASE WHEN st.ep % 6 <> 0 THEN max(n) - 20 END AS length, CASE WHEN st.ep % 5 <> 0 THEN list(c ORDER BY i) END AS every, CASE WHEN st.ep % 5 <> 0 THEN list(c) FILTER (i IN (2, 3, 5, 6)) END AS pts FROM st GROUP BY st.ep),
ey AS (SELECT *, coalesce(list_sort(list_distinct(list_transform(pts, lambda x: greatest(0, least(x, coalesce(length, 0) - 1))))), []) AS steps, coalesce(list_sort(list_distinct(list_filter(pts, lambda x: x < 0 OR x >= coalesce(length, 0)))), []) AS clipped FROM ex)"""
_SAID = "'episode ' || episode_index || ': keyframe ' || x || ' outside [0,' || coalesce(length, 0) || '); clipped to ' || greatest(0, least(x, coalesce(length, 0) - 1))"


@query(f"{_EXPORT} SELECT episode_index, name, length, array_to_string(steps, ',') AS keyframe_steps, array_to_string(steps, ',') AS inspect_keyframe_steps, len(clipped) AS warnings, CASE WHEN pts IS NOT NULL THEN ep || '|eventvla4|' || array_to_string(every, ',') || '|' || CASE WHEN ep % 2 = 0 THEN 'a,b' ELSE 'grasp_tube,start_pour,release_tube,grasp_pestle,start_grind,lift_pestle' END END AS source FROM ey")
def keyframe_rows(spark, d):
    rows = _exported(spark, d)
    joined = lambda c: F.array_join(c, ",")
    source = F.concat(C("source.annotation_episode"), F.lit("|"), C("source.points"), F.lit("|"), joined("source.critical_points"), F.lit("|"), joined("source.critical_names"))
    return rows.select("episode_index", "name", "length", *(joined(c).alias(c) for c in ("keyframe_steps", "inspect_keyframe_steps")), F.size("warnings").cast("long").alias("warnings"), source.alias("source"))


@query(f"{_EXPORT} SELECT count(*) AS episodes, count(*) FILTER (len(steps) > 0) AS with_keyframes, array_to_string(list(episode_index ORDER BY episode_index) FILTER (len(steps) = 0), ',') AS missing, array_to_string(list(episode_index ORDER BY episode_index) FILTER (len(clipped) > 0), ',') AS warnings, count(*) FILTER (pts IS NULL) AS missing_count, sum(len(clipped))::BIGINT AS warning_count FROM ey")
def keyframe_report(spark, d):
    return export.summary(_exported(spark, d))


@query(f"{_EXPORT} SELECT episode_index, {_SAID} AS remark FROM (SELECT *, unnest(clipped) AS x FROM ey) UNION ALL SELECT episode_index, 'missing annotation' FROM ey WHERE pts IS NULL")
def keyframe_remarks(spark, d):
    """The warnings of an export, and the episodes that have no annotation, each a row."""
    return export.remarks(_exported(spark, d))


_LOG = """lo AS (SELECT ep, k, 1 AS run, CASE WHEN (ep + k) % 3 <> 0 THEN (ep * 7 + k * 13) % 100 / 100.0 END AS score FROM sub WHERE ep % 2 = 0),
ln AS (SELECT ep, k, 2 AS run, CASE WHEN (ep + k) % 4 <> 0 THEN (ep * 3 + k * 5) % 100 / 100.0 END AS score FROM sub WHERE ep % 4 < 3 AND NOT EXISTS (SELECT 1 FROM lo WHERE lo.ep = sub.ep AND lo.k = sub.k AND lo.score IS NOT NULL)),
lg AS (SELECT ep, k, arg_max(run, (score IS NOT NULL)::INT * 10 + run) AS run, arg_max(coalesce(score, -1), (score IS NOT NULL)::INT * 10 + run) AS score FROM (FROM lo UNION ALL FROM ln) GROUP BY ep, k)"""


def _log(spark, d, points=None):
    """A verification log after a second run: what the first run scored is not asked again."""
    samples = intervals.subtasks(points or fr.state_points(spark, d)).select("ep", "k")
    score = lambda a, b: ((C("ep") * a + C("k") * b) % 100) / F.lit(100.0)
    old = samples.where("ep % 2 = 0").select("ep", "k", F.lit(1).alias("run"), F.when((C("ep") + C("k")) % 3 != 0, score(7, 13)).alias("score"))
    todo = quality.to_do(samples.where("ep % 4 < 3"), old, ["ep", "k"])
    new = todo.select("ep", "k", F.lit(2).alias("run"), F.when((C("ep") + C("k")) % 4 != 0, score(3, 5)).alias("score"))
    return quality.log(old, new, ["ep", "k"], "run")


@query(f"{_LOG} SELECT ep, k, run, CASE WHEN score >= 0 THEN CAST(score AS DOUBLE) END AS score FROM lg")
def verification_log(spark, d):
    return _log(spark, d)


_QUALITY = f"""{_LOG}, fs AS (SELECT ep, round(avg(CAST(score AS DOUBLE)) FILTER (score >= 0), 4) AS future, count(*) FILTER (score >= 0) AS verified FROM lg GROUP BY ep), ea AS (SELECT ep, round(avg(score), 4) AS edges, count(*) AS stages FROM ({_EDGE_SCORE}) GROUP BY ep),
qu AS (SELECT sc.ep, sc.score AS "interval", edges, stages, coalesce(future, 0) AS future, coalesce(verified, 0) AS verified, floor((3 * CAST(round(sc.score * 10000) AS BIGINT) + 3 * CAST(round(edges * 10000) AS BIGINT) + 4 * CAST(round(coalesce(future, 0) * 10000) AS BIGINT) + 5) / 10.0) / 10000 AS quality FROM sc JOIN ea USING (ep) LEFT JOIN fs USING (ep))"""


def _qualities(spark, d):
    """A row per episode: its scores, what they come to, and how many stages there are and are verified; unverified ones count as 0."""
    points = fr.points_once(spark, d)
    future = _log(spark, d, points).groupBy("ep").agg(F.round(F.avg("score"), 4).alias("future"), F.count("score").alias("verified"))
    edges = _edges(spark, d, points).groupBy("ep").agg(F.round(F.avg("score"), 4).alias("edges"), F.count(F.lit(1)).alias("stages"))
    rows = intervals.interval_score(fr.proposed_stages(spark, d, points)).withColumnRenamed("score", "interval").join(edges, "ep").join(future, "ep", "left")
    rows = rows.withColumns({"future": F.coalesce("future", F.lit(0.0)), "verified": F.coalesce("verified", F.lit(0))})
    return rows.withColumn("quality", quality.rolled_up(C("interval"), C("edges"), C("future")))


@query(f'{_QUALITY} SELECT ep, "interval", edges, stages, future, verified, quality FROM qu')
def episode_quality(spark, d):
    return _qualities(spark, d).select("ep", "interval", "edges", "stages", "future", "verified", "quality")


@query(f'{_QUALITY} SELECT count(*) AS episodes, round(avg("interval"), 4) AS mean_interval, round(avg(edges), 4) AS mean_edges, round(avg(future), 4) AS mean_future, round(avg(quality), 4) AS mean_quality, sum(stages)::BIGINT AS stages, sum(verified)::BIGINT AS verified FROM qu')
def quality_global(spark, d):
    """Means and sums over all episodes."""
    return quality.means(_qualities(spark, d), ["interval", "edges", "future", "quality"], ["stages", "verified"])


@query("SELECT count(*) FILTER (review) AS points, count(DISTINCT ep) FILTER (review) AS episodes, count(DISTINCT ep) AS of FROM fu")
def review_totals(spark, d):
    """How many fused points are for review, and in how many episodes."""
    some = _fused(spark, d).groupBy("ep").agg(F.count_if("review").alias("points"))
    return some.agg(F.sum("points").alias("points"), F.count_if(C("points") > 0).alias("episodes"), F.count(F.lit(1)).alias("of"))


@query("""hg AS (SELECT sub.ep, k, sub.ep % 3 AS said, arg_max(a, f) - arg_min(a, f) AS da, arg_max(b, f) - arg_min(b, f) AS db, max(a) - min(a) AS sa, max(b) - min(b) AS sb, max(wa_) AS wa_, max(wb_) AS wb_
FROM sub JOIN (SELECT *, max(a) OVER (PARTITION BY ep) - min(a) OVER (PARTITION BY ep) AS wa_, max(b) OVER (PARTITION BY ep) - min(b) OVER (PARTITION BY ep) AS wb_ FROM fr) x ON x.ep = sub.ep AND f BETWEEN first AND last GROUP BY sub.ep, k),
hh AS (SELECT ep, k, CASE WHEN said = 0 THEN 'left' WHEN said = 1 THEN 'right' WHEN abs(da) >= abs(db) THEN 'left' ELSE 'right' END AS hand, da, db, sa, sb, wa_, wb_ FROM hg),
hi AS (SELECT ep, k, hand, ['reach', 'transport', 'place', 'release', 'grasp', 'adjust', 'done'][k + 1] AS stage, CASE hand WHEN 'left' THEN da ELSE db END AS d, CASE hand WHEN 'left' THEN sa ELSE sb END AS spread, CASE hand WHEN 'left' THEN wa_ ELSE wb_ END AS w FROM hh)
SELECT ep, k, hand, CASE WHEN stage = 'grasp' THEN CASE WHEN -d > 0.3 * w THEN 1.0 WHEN -d > 0.1 * w THEN 0.7 WHEN abs(d) <= 0.1 * w THEN 0.4 ELSE 0.0 END
WHEN stage = 'release' THEN CASE WHEN d > 0.3 * w THEN 1.0 WHEN d > 0.1 * w THEN 0.7 WHEN abs(d) <= 0.1 * w THEN 0.4 ELSE 0.0 END
WHEN stage = 'transport' THEN CASE WHEN spread / w <= 0.1 THEN 1.0 WHEN spread / w <= 0.2 THEN 0.7 WHEN spread / w <= 0.4 THEN 0.4 ELSE 0.0 END
WHEN stage IN ('reach', 'done') THEN CASE WHEN spread / w <= 0.1 THEN 1.0 ELSE 0.7 END ELSE 0.7 END::DOUBLE AS score FROM hi""")
def boundary_by_hand(spark, d):
    """How well each stage's edges fit the gripper that its text names, or else the one that changes more."""
    index = intervals.dense(intervals.subtasks(fr.points_once(spark, d)))
    rows = fr.frames(spark, d).withColumns({f"w{x}": (F.max(x).over(P()) - F.min(x).over(P())).cast("double") for x in "ab"})
    of = lambda x: F.struct((F.max_by(x, "f") - F.min_by(x, "f")).alias("d"), (F.max(x) - F.min(x)).alias("spread"), F.max(f"w{x}").alias("w")).alias(x)
    rows = rows.join(index, ["ep", "f"]).groupBy("ep", "k").agg(of("a"), of("b"))
    text = F.when(C("ep") % 3 == 0, "Move the LEFT gripper, not the right one").when(C("ep") % 3 == 1, "bright light").otherwise("Move")
    hand = quality.gripper(text, C("a.d"), C("b.d"))
    stage = F.array(*map(F.lit, fr.STAGE_OF))[C("k").cast("int")]
    rows = rows.withColumn("hand", hand).withColumn("of", F.when(C("hand") == "left", C("a")).otherwise(C("b")))
    return rows.select("ep", "k", "hand", quality.boundary(stage, C("of.d"), C("of.spread"), C("of.w")).alias("score"))


@query("SELECT sn.ep, sn.ep % 3 <> 0 AS found, CASE WHEN sn.ep % 3 <> 0 THEN p END AS points FROM sn LEFT JOIN (SELECT ep, count(*) AS p FROM st GROUP BY ep) USING (ep) WHERE sn.ep < 40")
def first_episodes(spark, d):
    """Episodes below a number with the annotations that there are; the others are named, too."""
    episodes = fr.frames(spark, d).select("ep").distinct().where("ep < 40")
    annotated = fr.state_points(spark, d).where("ep % 3 <> 0").groupBy("ep").agg(F.count(F.lit(1)).alias("points"))
    both, missing = fusion.matched(episodes, annotated, "ep")
    return both.select("ep", F.lit(True).alias("found"), "points").unionByName(missing.select("ep", F.lit(False).alias("found")), allowMissingColumns=True)


@query("SELECT ep, row_number() OVER (ORDER BY ep) - 1 AS place FROM (SELECT DISTINCT ep FROM fr) QUALIFY place IN (1, 3, 4)")
def subset_by_place(spark, d):
    """Episodes by their place in the sorted list."""
    return demos.by_place(fr.frames(spark, d).select("ep").distinct(), "ep", [1, 3, 4])


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 50 END AS frame, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN event_id % 50 WHEN 2 THEN event_id % 50 ELSE round_even((event_id % 50) + 0.5, 0)::BIGINT END AS chosen FROM events")
def selected_frame(spark, d):
    """Frames as replies give them: absent, numbers, texts, halves."""
    k = (C("event_id") % 50).cast("string")
    raw = F.when(C("event_id") % 4 == 0, '{"x": 1}').when(C("event_id") % 4 == 1, F.concat(F.lit('{"selected_frame": '), k, F.lit("}")))
    raw = raw.when(C("event_id") % 4 == 2, F.concat(F.lit('{"selected_frame": "'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"selected_frame": '), k, F.lit(".5}")))
    return fr.events(spark, d).select("event_id", F.when(C("event_id") % 4 != 0, C("event_id") % 50).alias("frame"), replies.selected(raw, C("user_id")).alias("chosen"))
