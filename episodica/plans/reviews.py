"""Queries that review points by what a model answers, and streams by their clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import align, prior, verify
from episodica.plans import frames as fr
from episodica.plans.registry import query
from episodica.sources import demos, named_files
from episodica.sources.scratch import cut, fresh

C = F.col
NAMES = ["grasp_tube", "start_pour", "release_tube", "grasp_pestle", "start_grind", "lift_pestle"]


def _requests(spark, d):
    return verify.point_requests(fr.state_points(spark, d), NAMES, fps=10, task="Pour and grind", reach_s=1.0)


def _decisions(spark, d):
    """Questions about the state's points, answered by what the other track says; a sixth of the answers are errors."""
    said = fr.other_points(spark, d).select(F.format_string("%06d-%d", "ep", "i").alias("request_id"), "ep", "i", "c")
    sure = F.when((C("ep") + C("i")) % 5 == 0, "rather LOW").when((C("ep") + C("i")) % 5 == 1, "Medium").otherwise("high")
    seen = F.when((C("ep") + C("i")) % 4 == 0, " ").otherwise("powder flows")
    form = '```json\n{"selected_frame": "%d.4", "confidence": "%s", "visual_evidence": "%s"}\n```'
    failed = (C("ep") + C("i")) % 6 == 0
    answers = said.select("request_id", F.when(~failed, F.format_string(form, "c", sure, seen)).alias("raw_response"), F.when(failed, "TimeoutError").alias("error"))
    return verify.decided(_requests(spark, d), answers, fps=10, most_s=0.8)


_DECIDED = """pv0 AS (SELECT cf.ep, cf.i, cf.c, cf.n, cand, vl.c AS said, (cf.ep + cf.i) % 6 <> 0 AND vl.c IS NOT NULL AS has, CASE (cf.ep + cf.i) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS conf FROM cf LEFT JOIN vl USING (ep, i)),
pv1 AS (SELECT *, CASE WHEN has THEN list_sort(list_transform(cand, lambda x: [abs(x - said), x]))[1][2] ELSE c END AS sel FROM pv0),
pv2 AS (SELECT *, sel - c AS delta, CASE WHEN NOT has THEN 'no_reply' WHEN conf <> 'high' THEN 'confidence_not_high' WHEN abs(sel - c) > 8 THEN 'move_too_large' WHEN (ep + i) % 4 = 0 THEN 'missing_evidence' WHEN i <> 2 THEN 'record_only_non_p2' WHEN abs(sel - c) < 2 THEN 'move_too_small' ELSE 'accepted' END AS decision FROM pv1),
pv3 AS (SELECT *, least(i + max(least(greatest(CASE WHEN decision = 'accepted' THEN sel ELSE c END, 1), n - 2) - i) OVER (PARTITION BY ep ORDER BY i ROWS UNBOUNDED PRECEDING), n - 2 - (6 - i)) AS after FROM pv2)"""


@query(f"{_DECIDED} SELECT ep, i, c, sel AS selected, delta, CASE WHEN has THEN conf END AS confidence, decision FROM pv2")
def point_decisions(spark, d):
    return _decisions(spark, d).select("ep", "i", "c", "selected", "delta", "confidence", "decision")


@query(f"""{_DECIDED} SELECT ep AS episode_index, count(*) FILTER (after <> c) AS moved_points, count(*) FILTER (has AND conf = 'high') AS high_conf_points, max(abs(delta)) AS max_abs_delta,
array_to_string(list(c ORDER BY i), ' ') AS state_cps, array_to_string(list(after ORDER BY i), ' ') AS proposal_cps, array_to_string(list(decision ORDER BY i), ';') AS decisions FROM pv3 GROUP BY ep""")
def point_report(spark, d):
    return verify.report(_decisions(spark, d))


@query("""im AS (SELECT cf.ep, cf.i, cam, x, 100 * cam + list_position(cand, x) AS place FROM cf, (VALUES (0), (1)) cams(cam), unnest(cand) AS t(x) WHERE (ep + x + cam) % 3 <> 0)
SELECT cf.ep, cf.i, count(im.x) AS images, coalesce(string_agg('camera' || cam || ':' || x, ' ' ORDER BY place), '') AS names FROM cf LEFT JOIN im USING (ep, i) GROUP BY cf.ep, cf.i""")
def point_images(spark, d):
    """Which of the wanted images of a question's frames there are, camera by camera."""
    asked = _requests(spark, d)
    there = asked.select("ep", F.explode("frames").alias("x")).distinct().withColumn("cam", F.explode(F.array(F.lit(0), F.lit(1)))).where((C("ep") + C("x") + C("cam")) % 3 != 0)
    names = there.select(F.format_string("keyframes/episode_%06d_camera%d_t%04d.jpg", "ep", "cam", "x").alias("name"))
    found = verify.with_images(asked, names, ["camera0", "camera1"])
    short = F.transform("images", lambda x: F.concat(F.regexp_extract(x, r"(camera\d)", 1), F.lit(":"), F.regexp_extract(x, r"_t(\d+)\.", 1).cast("long")))
    return found.select("ep", "i", F.size("images").cast("long").alias("images"), F.array_join(short, " ").alias("names"))


_NEAREST = """nr AS (SELECT l.ep, l.id, l.t, arg_max(r.t, r.t) FILTER (r.t < l.t) AS pt, max([r.t, r.v]) FILTER (r.t < l.t) AS p, arg_min(r.t, r.t) FILTER (r.t >= l.t) AS nt, min([r.t, r.v]) FILTER (r.t >= l.t) AS q
FROM (SELECT ep, f AS id, t FROM ck WHERE kind = 'click') l LEFT JOIN (SELECT ep, t, a AS v FROM ck WHERE kind = 'view') r ON l.ep = r.ep GROUP BY ALL)"""


@query(f"{_NEAREST} SELECT ep, id, t, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN p[1] ELSE q[1] END AS rt, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN p[2] ELSE q[2] END AS v FROM nr")
def sliced_align(spark, d):
    """Nearest samples, with every episode dealt to tasks in slices of an hour."""
    rows = fr.frames(spark, d).withColumn("t", C("us") - F.min("us").over(align.Window.partitionBy("ep")))
    left = rows.where("kind = 'click'").select("ep", "t", C("f").alias("id"))
    return align.nearest_sample(left, rows.where("kind = 'view'").select("ep", "t", C("a").alias("v")), 3_600_000_000)


def _stamped(spark, d):
    """hands, times, videos, stamps and starts: stamps are read from JSON lines of which some are bad.

    A hundred episodes' files share a folder, which one task writes and one reads; each file is read once.
    """
    rows = fr.frames(spark, d)
    sizes = rows.groupBy("ep").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("us0"), F.count_if((C("kind") == "view") & (C("b") % 9 != 0)).alias("views"))
    times = rows.where("ep % 4 <> 3").select("ep", C("f").alias("place"), (C("us") / 1e6).alias("t"))
    stamp = F.when(C("b") % 9 != 0, F.format_string('{"timestamp_ns": %d, "x": 1}', C("us") * 1000)).otherwise('{"timestamp_ns": oops')
    folder, group = fresh(spark, "stamps"), F.floor(C("ep") / 100)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    views = rows.where("kind = 'view'").select("ep", "f", group.alias("group"), F.concat(stamp, F.lit("\n")).alias("content"))
    views = views.repartition(parts, "group").sortWithinPartitions("group", "ep", "f")
    named_files.write_files(views.select(F.format_string("%d/%d/left.jsonl", "group", "ep").alias("name"), "content"), folder)
    stamps = cut(demos.stamps_in(spark, folder).select(C("demo").cast("long").alias("ep"), "place", "t"))
    videos = sizes.where("ep % 7 <> 0").select("ep", (C("views") + F.when(C("ep") % 5 == 0, 1).otherwise(0)).alias("frames"))
    starts = sizes.where("ep % 3 <> 0").select("ep", (C("us0") - 2_500_000).alias("unix_us"), (C("us0") - 7_000_000).alias("ticks_us"))
    return sizes.select("ep", "n"), times, videos, stamps, starts


_STAMPS = """es AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY f) - 1 AS place, us * 1000 AS ns FROM fr WHERE kind = 'view' AND b % 9 <> 0),
ev AS (SELECT ep, n, us0, CASE WHEN ep % 7 <> 0 THEN views + CASE WHEN ep % 5 = 0 THEN 1 ELSE 0 END END AS frames, views, ns0, (ns1 - ns0)::DOUBLE / 1e9 AS span, us1 / 1e6 - us0 / 1e6 AS hand FROM
  (SELECT fr.ep, count(*) AS n, min(us) AS us0, arg_min(us, f) AS usa, arg_max(us, f) AS us1, count(*) FILTER (kind = 'view' AND b % 9 <> 0) AS views FROM fr GROUP BY fr.ep) LEFT JOIN (SELECT ep, arg_min(ns, place) AS ns0, arg_max(ns, place) AS ns1 FROM es GROUP BY ep) USING (ep)),
ew_ AS (SELECT *, ep % 4 <> 3 AND n >= 2 AND hand > 0 AS timed, coalesce(views = frames AND span > 0, false) AS fits FROM ev),
ex_ AS (SELECT fr.ep, f, ew_.n, frames, fits, ns0, CASE WHEN timed THEN us / 1e6 - us0 / 1e6 ELSE f / 60.0::DOUBLE END AS he, CASE WHEN timed THEN hand ELSE (ew_.n - 1) / 60.0::DOUBLE END AS last FROM fr JOIN ew_ USING (ep) WHERE frames > 0),
ma AS (SELECT ex_.ep, f, arg_min(place, [abs(he - (ns - ns0)::DOUBLE / 1e9), place]) AS hit FROM ex_ JOIN es USING (ep) WHERE fits GROUP BY ex_.ep, f
  UNION ALL SELECT ep, f, round_even(CASE WHEN last > 0 THEN he / last ELSE 0 END * (frames - 1), 0)::BIGINT FROM ex_ WHERE NOT fits)"""


@query(f"{_STAMPS} SELECT ep, f, hit AS \"at\" FROM ma")
def matched_frames(spark, d):
    """For each frame of a hand's camera the frame of the headset's video, by stamps or, where these do not fit, by shares."""
    hands, times, videos, stamps, _ = _stamped(spark, d)
    return align.matched(hands, times, videos, stamps, slice_s=7200.0)


@query(f"""{_STAMPS} SELECT ew_.ep, coalesce(frames > 0, false) AS ok, CASE WHEN coalesce(frames > 0, false) THEN NULL ELSE 'no ego video' END AS reason, CASE WHEN frames > 0 THEN n END AS hand_frames, CASE WHEN frames > 0 THEN round(CASE WHEN timed THEN hand ELSE (n - 1) / 60.0::DOUBLE END, 3) END AS hand_dur_s,
CASE WHEN frames > 0 THEN frames END AS ego_frames, CASE WHEN frames > 0 AND fits THEN round(span, 3) END AS ego_dur_s, CASE WHEN frames > 0 AND fits AND ep % 4 <> 3 AND ep % 3 <> 0 THEN round((us0 - 2500000) / 1e6 + (ns0 / 1e9 - (us0 - 7000000) / 1e6) - us0 / 1e6, 1) END AS device_clock_offset_s, a AS ego_first_used, b AS ego_last_used
FROM ew_ LEFT JOIN (SELECT ep, min(hit) AS a, max(hit) AS b FROM ma GROUP BY ep) USING (ep)""")
def alignment_report(spark, d):
    return align.alignment_report(*_stamped(spark, d)).drop("mode", "offset_s")


@query("""pp AS (SELECT ep, n, ep % 4 AS form, list(c ORDER BY i)[1:5] AS five FROM st GROUP BY ep, n),
pq AS (SELECT ep, n, form, CASE form WHEN 0 THEN five WHEN 3 THEN list_reverse(five) ELSE list_transform([0.20, 0.37, 0.50, 0.77, 0.91], lambda p: CAST(floor(p::DOUBLE * n) AS BIGINT)) END AS raw FROM pp),
pr_ AS (SELECT ep, n, form, i, i + max(greatest(1, least(n - 2, raw[i])) - i) OVER (PARTITION BY ep ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, unnest(range(1, 6)) AS i FROM pq))
SELECT ep, array_to_string(list(c ORDER BY i), ',') AS points, form IN (1, 2) AS fallback FROM pr_ GROUP BY ep, form""")
def prior_points(spark, d):
    """Points of replies that name them all, in or out of order; shares where a point is missing, or all are."""
    asked = prior.requests(fr.frames(spark, d).groupBy("ep").agg(F.count(F.lit(1)).alias("n")), fps=10)
    five = fr.state_points(spark, d).groupBy("ep").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), 1, 5).alias("p"))
    form = "#0: a hand\n{" + ", ".join(f'"{key}": "%d.2"' for key in prior.KEYS) + "}"
    listed = lambda p: F.format_string(form, *(p[k] for k in range(5)))
    raw = F.when(C("ep") % 4 == 0, listed(C("p"))).when(C("ep") % 4 == 1, F.format_string('{"c1_grasp_tube": %d}', C("p")[0])).when(C("ep") % 4 == 3, listed(F.reverse("p")))
    found = prior.proposed(asked, five.select(F.format_string("prior-%06d", "ep").alias("request_id"), raw.alias("raw_response")))
    return found.select("ep", F.array_join("points", ",").alias("points"), (F.size("flags") > 0).alias("fallback"))


@query("""fd0 AS (SELECT st.ep, st.i, st.n, st.c AS state, vl.c AS v, abs(vl.c - st.c) AS d, CASE WHEN st.i IN (2, 5) AND vl.c IS NOT NULL AND abs(vl.c - st.c) <= 4 THEN vl.c ELSE st.c END AS val FROM st LEFT JOIN vl USING (ep, i)),
fd1 AS (SELECT *, greatest(1, least(val, n - 2)) AS clip FROM fd0), fd2 AS (SELECT *, i + max(clip - i) OVER (PARTITION BY ep ORDER BY i ROWS UNBOUNDED PRECEDING) AS fwd FROM fd1)
SELECT ep AS episode_index, array_to_string(list(least(fwd, n - 2 - (6 - i)) ORDER BY i), ',') AS critical_points, array_to_string(list(CASE WHEN i IN (2, 5) AND v IS NOT NULL THEN 'other' ELSE 'state' END ORDER BY i), ',') AS sources,
  coalesce(array_to_string(list(d ORDER BY i) FILTER (d IS NOT NULL), ','), '') AS disagree_frames, coalesce(array_to_string(list(i ORDER BY i) FILTER (coalesce(d > 4, true)), ','), '') AS review_points,
  concat_ws('|', string_agg('p' || i || ': vlm-owned but disagrees, used state', '|' ORDER BY i) FILTER (i IN (2, 5) AND d > 4), CASE WHEN count(v) = 0 THEN 'no vlm annotation -> all points from state' END, string_agg('nudged p' || i || ' for ordering', '|' ORDER BY i) FILTER (i > 1 AND fwd <> clip)) AS flags FROM fd2 GROUP BY ep""")
def fused_documents(spark, d):
    """A document per episode after the fusion of two tracks, with sources, differences, points for review and flags."""
    found = prior.fused_documents(fr.points_once(spark, d), fr.other_points(spark, d), 4, [2, 5])
    joined = lambda c, by=",": F.array_join(c, by).alias(c)
    return found.select("episode_index", *(joined(c) for c in ("critical_points", "sources", "disagree_frames", "review_points")), joined("flags", "|"))
