"""Common table expressions in DuckDB's SQL that the queries' oracles share."""

from __future__ import annotations


def _hold(name: str, source: str, mask: str, gap: int) -> str:
    """Runs r<name>_, closed frames f<name>_ and the longest run h<name> of a mask over a relation (ep, f, ...)."""
    return f"""
x{name}_ AS (SELECT ep, f, {mask} AS m FROM {source}),
i{name}_ AS (SELECT *, f - row_number() OVER (PARTITION BY ep, m ORDER BY f) AS g, max(f) OVER (PARTITION BY ep) AS z FROM x{name}_),
r{name}_ AS (SELECT ep, m AS on_, min(f) AS first, max(f) AS last FROM i{name}_ GROUP BY ep, m, g),
w{name}_ AS (SELECT *, min(f) OVER (PARTITION BY ep, m, g) AS a0, max(f) OVER (PARTITION BY ep, m, g) AS b0 FROM i{name}_),
f{name}_ AS (SELECT ep, f, m OR (a0 > 0 AND b0 < z AND b0 - a0 + 1 < {gap}) AS closed FROM w{name}_),
j{name}_ AS (SELECT *, f - row_number() OVER (PARTITION BY ep, closed ORDER BY f) AS g FROM f{name}_),
k{name}_ AS (SELECT ep, min(f) AS s, max(f) + 1 AS e FROM j{name}_ WHERE closed GROUP BY ep, g),
l{name}_ AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY e - s DESC, s) AS rn FROM k{name}_),
h{name} AS (SELECT q.ep, coalesce(l.s, 0) AS s, coalesce(l.e, 0) AS e FROM (SELECT DISTINCT ep FROM x{name}_) q LEFT JOIN l{name}_ l ON l.ep = q.ep AND l.rn = 1)"""


_AROUND = "OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"
_SHARE = "CAST(floor({}::DOUBLE * n) AS BIGINT)"
_FALLBACK = ", ".join(_SHARE.format(p) for p in ("0.12", "0.20", "0.34", "0.52", "0.62", "0.90"))
EGO_FALLBACK = ", ".join(_SHARE.format(p) for p in ("0.20", "0.37", "0.45", "0.77", "0.91"))


def _motion(source: str, dims: str, raw: int, carrier: int, zscore: bool) -> str:
    """Smoothed speed and drift of dims over windows of raw and carrier frames to either side, as whole numbers."""
    z = ", ".join(f"CAST(round(({d} - avg({d}) OVER (PARTITION BY ep)) / (stddev_pop({d}) OVER (PARTITION BY ep) + 1e-9) * 10000) AS BIGINT) AS z{d}" if zscore else f"{d} AS z{d}" for d in dims)
    smooth = ", ".join(f"CAST(sum(z{d}) {_AROUND.format(carrier)} AS BIGINT) AS c{d}" for d in dims)
    step = lambda p, d: f"coalesce({p}{d} - lag({p}{d}) OVER (PARTITION BY ep ORDER BY f), 0)"
    length = lambda p: "sqrt(CAST(" + " + ".join(f"power({step(p, d)}, 2)" for d in dims) + " AS DOUBLE))"
    return f"""SELECT ep, f, n, a, b, tube, pestle, hand, x, y, CAST(sum(r) {_AROUND.format(raw)} AS BIGINT) AS raw, CAST(sum(d) {_AROUND.format(raw)} AS BIGINT) AS drift FROM
  (SELECT *, CAST(round({length("z")}) AS BIGINT) AS r, CAST(round({length("c")}) AS BIGINT) AS d FROM (SELECT *, {smooth} FROM (SELECT *, {z} FROM {source})))"""

PRELUDE = f"""
fr AS (SELECT user_id AS ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, count(*) OVER (PARTITION BY user_id) AS n,
  CAST(round(value * 100) AS BIGINT) AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b, epoch_us(ts) AS us, event_type AS kind FROM events),
ck AS (SELECT *, us - min(us) OVER (PARTITION BY ep) AS t FROM fr),
sm AS (SELECT *, CAST(sum(a) {_AROUND.format(4)} AS BIGINT) AS s9, CAST(sum(a) {_AROUND.format(2)} AS BIGINT) AS s5, CAST(sum(a) {_AROUND.format(7)} AS BIGINT) AS wa, CAST(sum(b) {_AROUND.format(7)} AS BIGINT) AS wb FROM fr),
df AS (SELECT *, coalesce(a - lag(a) OVER (PARTITION BY ep ORDER BY f), 0) AS da, coalesce(b - lag(b) OVER (PARTITION BY ep ORDER BY f), 0) AS db,
  coalesce(wa - lag(wa) OVER (PARTITION BY ep ORDER BY f), 0) AS dwa, coalesce(wb - lag(wb) OVER (PARTITION BY ep ORDER BY f), 0) AS dwb FROM sm),
pc AS (SELECT ep, round(quantile_cont(a, 0.01), 6) AS a1, round(quantile_cont(a, 0.99), 6) AS a99, round(quantile_cont(b, 0.01), 6) AS b1, round(quantile_cont(b, 0.99), 6) AS b99 FROM fr GROUP BY ep),
nm AS (SELECT fr.*, round(least(1.0, greatest(0.0, (a - a1) / (a99 - a1 + 1e-9))), 6) AS ga, round(least(1.0, greatest(0.0, (b - b1) / (b99 - b1 + 1e-9))), 6) AS gb FROM fr JOIN pc USING (ep)),
rs AS (SELECT ep, round(median(ga) FILTER (f < greatest(5, n // 20)), 6) AS ra, round(median(gb) FILTER (f < greatest(5, n // 20)), 6) AS rb FROM nm GROUP BY ep),
mk AS (SELECT nm.*, ra, rb, abs(ga - ra) > 0.35 AS ca, abs(gb - rb) > 0.35 AS cb FROM nm JOIN rs USING (ep)),
{_hold("a", "mk", "ca", 3)},
{_hold("b", "mk", "cb", 3)},
mv0 AS (SELECT *, CASE WHEN f * 100 >= n * (14 + ep % 6) AND f * 100 < n * (42 + ep % 5) AND ep % 11 <> 0 THEN 300 ELSE 1000 END + b % 20 AS tube, CASE WHEN f * 100 >= n * (14 + ep % 6) AND f * 100 < n * 95 AND ep % 11 <> 0 THEN 300 ELSE 1000 END + b % 20 AS hand,
  CASE WHEN f * 100 >= n * (50 + ep % 4) AND f * 100 < n * (90 + ep % 4) AND ep % 13 <> 0 THEN 300 ELSE 1000 END + a % 20 AS pestle,
  CASE WHEN f * 100 >= n * 28 AND f * 100 < n * 42 THEN (n * 28) // 100 * 30 WHEN f * 100 >= n * 60 AND f * 100 < n * 85 AND ep % 7 <> 0 THEN 2000 + (f % 2) * 120 ELSE f * 30 END + b % 7 AS x,
  f * 5 + a % 9 AS y, (f % 3) * 10 + b % 4 AS z FROM fr),
mo AS ({_motion("mv0", "xy", 1, 5, True)}),
tp AS (SELECT ep, round(quantile_cont(tube, 0.01), 6) AS t1, round(quantile_cont(tube, 0.99), 6) AS t99, round(quantile_cont(pestle, 0.01), 6) AS q1, round(quantile_cont(pestle, 0.99), 6) AS q99, round(quantile_cont(hand, 0.01), 6) AS h1, round(quantile_cont(hand, 0.99), 6) AS h99 FROM mv0 GROUP BY ep),
tn AS (SELECT mo.*, round(least(1.0, greatest(0.0, (tube - t1) / (t99 - t1 + 1e-9))), 6) AS gt, round(least(1.0, greatest(0.0, (pestle - q1) / (q99 - q1 + 1e-9))), 6) AS gp, round(least(1.0, greatest(0.0, (hand - h1) / (h99 - h1 + 1e-9))), 6) AS gh FROM mo JOIN tp USING (ep)),
tr AS (SELECT ep, round(median(gt) FILTER (f < greatest(5, n // 20)), 6) AS rt, round(median(gp) FILTER (f < greatest(5, n // 20)), 6) AS rp, round(median(gh) FILTER (f < greatest(5, n // 20)), 6) AS rh FROM tn GROUP BY ep),
tm AS (SELECT tn.*, rt, rp, rh, abs(gt - rt) > 0.35 AND f < CAST(floor(0.75::DOUBLE * n) AS BIGINT) AS tube_on, abs(gp - rp) > 0.35 AS pestle_on FROM tn JOIN tr USING (ep)),
{_hold("tube", "tm", "tube_on", 4)},
sn AS (SELECT ep, count(*) AS n FROM fr GROUP BY ep),
s1 AS (SELECT ep, n, e - 1 <= s OR e - 1 - s < 3 AS no_tube, CASE WHEN e - 1 <= s OR e - 1 - s < 3 THEN CAST(floor(0.12::DOUBLE * n) AS BIGINT) ELSE s END AS e1,
  CASE WHEN e - 1 <= s OR e - 1 - s < 3 THEN CAST(floor(0.34::DOUBLE * n) AS BIGINT) ELSE e - 1 END AS e2 FROM htube JOIN sn USING (ep)),
sd AS (SELECT tm.ep, tm.f - e1 AS f, drift < quantile_cont(drift, 0.45) OVER (PARTITION BY tm.ep) AS low FROM tm JOIN s1 USING (ep) WHERE tm.f BETWEEN e1 AND e2),
{_hold("sd", "sd", "low", 5)},
s2 AS (SELECT s1.*, least(greatest(CASE WHEN e2 - e1 + 1 >= 3 THEN e1 + hsd.s ELSE e1 + CAST(floor(0.4::DOUBLE * (e2 - e1)) AS BIGINT) END, e1 + 1), e2 - 1) AS onset FROM s1 LEFT JOIN hsd USING (ep)),
pm AS (SELECT tm.ep, tm.f, pestle_on AND tm.f > e2 AS pestle_on FROM tm JOIN s2 USING (ep)),
{_hold("pestle", "pm", "pestle_on", 4)},
s3 AS (SELECT s2.*, e - 1 <= s OR e - 1 - s < 3 AS no_pestle, CASE WHEN e - 1 <= s OR e - 1 - s < 3 THEN CAST(floor(0.58::DOUBLE * n) AS BIGINT) ELSE s END AS f1,
  CASE WHEN e - 1 <= s OR e - 1 - s < 3 THEN CAST(floor(0.92::DOUBLE * n) AS BIGINT) ELSE e - 1 END AS f2 FROM s2 JOIN hpestle USING (ep)),
gm AS (SELECT tm.ep, tm.f, drift < quantile_cont(drift, 0.40) OVER (PARTITION BY tm.ep) AND raw * 100 > max(raw) OVER (PARTITION BY tm.ep) * 12 AND tm.f > f1 AS busy FROM tm JOIN s3 USING (ep)),
{_hold("grind", "gm", "busy", 12)},
s4 AS (SELECT s3.*, NOT (e - s > 8) AS no_grind, CASE WHEN e - s > 8 THEN s ELSE CAST(floor(f1 + 0.1::DOUBLE * n) AS BIGINT) END AS gs, CASE WHEN e - s > 8 THEN e - 1 ELSE f2 END AS ge FROM s3 JOIN hgrind USING (ep)),
s5 AS (SELECT *, [e1, onset, e2 + 1, f1, gs, least(ge + 1, f2)] AS raw FROM s4),
s6 AS (SELECT *, NOT coalesce(raw[1] > 0 AND raw[1] < raw[2] AND raw[2] < raw[3] AND raw[3] < raw[4] AND raw[4] < raw[5] AND raw[5] < raw[6] AND raw[6] < n - 1, false) AS no_order FROM s5),
cq AS (SELECT *, CASE WHEN no_order THEN [{_FALLBACK}] ELSE raw END AS pts FROM s6),
st AS (SELECT ep, i, pts[i] AS c, n FROM (SELECT *, unnest(range(1, 7)) AS i FROM cq)),
el AS ({_motion("mv0", "xy", 0, 3, False)}),
er AS ({_motion("mv0", "xyz", 0, 3, False)}),
ew AS (SELECT el.ep, el.f, el.n, gh < rh - 0.45 AS left_on, gp < rp - 0.45 AS right_on, el.raw AS left_raw, el.drift AS left_drift, er.raw AS right_raw, er.drift AS right_drift
  FROM el JOIN er ON el.ep = er.ep AND el.f = er.f JOIN tm ON tm.ep = el.ep AND tm.f = el.f),
{_hold("left", "ew", "left_on", 3)},
{_hold("right", "ew", "right_on", 3)},
e1_ AS (SELECT ep, n, l.s AS ls, l.e AS le, r.s AS rs, r.e AS re, l.e - l.s >= r.e - r.s AS is_left FROM sn JOIN hleft l USING (ep) JOIN hright r USING (ep)),
e2_ AS (SELECT *, CASE WHEN is_left THEN ls ELSE rs END AS ts, CASE WHEN is_left THEN le ELSE re END AS te, CASE WHEN is_left THEN rs ELSE ls END AS cs, CASE WHEN is_left THEN re ELSE le END AS ce FROM e1_),
e3_ AS (SELECT ew.ep, ew.f - cs AS f, CASE WHEN is_left THEN right_raw ELSE left_raw END AS raw, CASE WHEN is_left THEN right_drift ELSE left_drift END AS drift FROM ew JOIN e2_ USING (ep) WHERE ew.f >= cs AND ew.f < ce),
e4_ AS (SELECT ep, f, raw * 100 > max(raw) OVER (PARTITION BY ep) * 15 AND drift < quantile_cont(drift, 0.45) OVER (PARTITION BY ep) AS busy, max(raw) OVER (PARTITION BY ep) AS top FROM e3_),
{_hold("wipe", "e4_", "busy", 5)},
e5_ AS (SELECT e2_.*, coalesce(w.s, 0) AS ws, coalesce(w.e, 0) AS we, coalesce(t.top, 0) AS top FROM e2_ LEFT JOIN hwipe w USING (ep) LEFT JOIN (SELECT ep, max(top) AS top FROM e4_ GROUP BY ep) t USING (ep)),
e6_ AS (SELECT *, ce - cs < 4 OR top <= 0 OR we - ws < 4 AS no_wipe FROM e5_),
e7_ AS (SELECT *, [ts, cs, CASE WHEN no_wipe THEN cs + CAST(floor(0.25::DOUBLE * (ce - cs)) AS BIGINT) ELSE cs + ws END, ce, te] AS raw FROM e6_),
eg AS (SELECT *, NOT (raw[1] > 0 AND raw[1] < raw[2] AND raw[2] < raw[3] AND raw[3] < raw[4] AND raw[4] < raw[5] AND raw[5] < n - 1) AS no_order FROM e7_),
vl AS (SELECT st.ep, st.i, greatest(0, least(st.c + fr.b % 21 - 10, st.n - 1)) AS c, st.n FROM st JOIN fr ON fr.ep = st.ep AND fr.f = st.i * 5 WHERE st.ep % 7 <> 0),
su AS (SELECT ep, i, c, n FROM st UNION ALL SELECT DISTINCT ep, 0, 0, n FROM st),
sub AS (SELECT ep, i AS k, c AS first, coalesce(lead(c) OVER (PARTITION BY ep ORDER BY i) - 1, n - 1) AS last, n FROM su),
fu AS (SELECT st.ep, st.i, CASE WHEN st.i IN (2, 5) AND vl.c IS NOT NULL AND abs(vl.c - st.c) <= 4 THEN vl.c ELSE st.c END AS c, st.n, abs(vl.c - st.c) AS d,
  CASE WHEN st.i IN (2, 5) AND vl.c IS NOT NULL THEN 'other' ELSE 'state' END AS source, coalesce(abs(vl.c - st.c) > 4, true) AS review FROM st LEFT JOIN vl USING (ep, i)),
cu AS (SELECT *, greatest(c - 10, coalesce(lag(c) OVER (PARTITION BY ep ORDER BY i) + 1, 0)) AS l0, least(c + 10, coalesce(lead(c) OVER (PARTITION BY ep ORDER BY i) - 1, n - 1)) AS h0 FROM st),
cw AS (SELECT ep, i, c, n, CASE WHEN h0 <= l0 THEN greatest(0, c - 5) ELSE l0 END AS lo, CASE WHEN h0 <= l0 THEN least(n - 1, c + 5) ELSE h0 END AS hi FROM cu),
cf AS (SELECT *, list_sort(list_distinct(list_append(list_transform(range(0, 7), lambda k: CAST(round_even(lo + k * ((hi - lo) / 6.0), 0) AS BIGINT)), c))) AS cand FROM cw),
mv AS (SELECT ep, i, delta, conf, CASE WHEN conf <> 'high' THEN 'confidence_not_high' WHEN abs(delta) > 8 THEN 'move_too_large' WHEN (ep + i) % 4 = 0 THEN 'missing_evidence' WHEN i <> 2 THEN 'record_only_non_p2' WHEN abs(delta) < 2 THEN 'move_too_small' ELSE 'accepted' END AS decision
  FROM (SELECT vl.ep, vl.i, vl.c - st.c AS delta, CASE (vl.ep + vl.i) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS conf FROM vl JOIN st USING (ep, i))),
pr AS (SELECT sub.ep, k + 1 AS i, first + b % 5 - 2 AS first, last + b % 7 - 3 AS last, sub.n FROM sub JOIN fr ON fr.ep = sub.ep AND fr.f = (k + 1) * 3),
n0 AS (SELECT *, CASE WHEN i = max(i) OVER (PARTITION BY ep) THEN n - 1 ELSE least(i + max(least(last, n - 1) - i) OVER (PARTITION BY ep ORDER BY i ROWS UNBOUNDED PRECEDING), n - 1) END AS "end" FROM pr),
n1 AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY ep ORDER BY i) + 1, 0) AS start FROM n0),
ns AS (SELECT ep, i, start, "end", n FROM n1 WHERE start < n AND "end" >= start),
hit AS (SELECT ep, n, unnest(range(first, last + 1)) AS t FROM pr),
per AS (SELECT ep, n, t, count(*) AS m FROM hit GROUP BY ALL),
sc AS (SELECT ep, round(greatest(0.0, 1 - (n - count(*) FILTER (t BETWEEN 0 AND n - 1) + coalesce(sum(m - 1) FILTER (t BETWEEN 0 AND n - 1), 0) + coalesce(sum(m) FILTER (t < 0 OR t >= n), 0)) / n), 4) AS score FROM per GROUP BY ep, n),
ei AS (SELECT CAST(label AS BIGINT) AS ep, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)) AS v FROM embeddings),
en AS (SELECT ep, f, CAST(coalesce(list_sum(list_transform(list_zip(v, p), lambda x: abs(x[1] - x[2]))), 0) AS BIGINT) AS energy FROM (SELECT *, lag(v) OVER (PARTITION BY ep ORDER BY f) AS p FROM ei)),
eo AS (SELECT *, energy > min(energy) OVER (PARTITION BY ep) + 0.5 * (round(quantile_cont(energy, 0.9) OVER (PARTITION BY ep), 4) - min(energy) OVER (PARTITION BY ep)) AS m9 FROM en),
{_hold("en", "eo", "m9", 2)}
"""
