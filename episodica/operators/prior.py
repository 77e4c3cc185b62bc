"""Points that a model proposes from some frames of an episode, with fixed shares where it proposes none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators import fusion

#: The points of the wiping task as replies name them, and the shares of an episode where they go without a reply.
KEYS = ("c1_grasp_tube", "c2_acquire_wiper", "c3_start_wipe", "c4_finish_wipe", "c5_release_tube")
SHARES = (0.20, 0.37, 0.50, 0.77, 0.91)
FLAG = "vlm parse failed -> fallback proportions"


def requests(episodes: DataFrame, fps: float, frames: int = 24) -> DataFrame:
    """(request_id, ep, n, frames, prompt): a question for each episode (ep, n) about evenly spaced frames of it."""
    k = F.least(F.lit(frames).cast("long"), F.col("n"))
    spread = lambda j: F.when(j == k - 1, F.col("n") - 1).otherwise(F.bround(j * ((F.col("n") - 1) / F.nullif(k - 1, F.lit(0).cast("long"))), 0)).cast("long")
    shown = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.when(j == 0, F.lit(0).cast("long")).otherwise(spread(j)))
    held = episodes.select("ep", F.col("n").cast("long").alias("n")).where("n > 0").withColumn("frames", shown)
    captions = F.array_join(F.transform("frames", lambda x: F.format_string("#%d %.1fs", x, x / F.lit(float(fps)))), ", ")
    form = "An episode of %d frames, of which these are shown: %s. Where do these points lie, each later than the one before? Answer with JSON: {%s}"
    keys = ", ".join(f'"{key}": frame' for key in KEYS)
    return held.select(F.format_string("prior-%06d", "ep").alias("request_id"), "ep", "n", "frames", F.format_string(form, "n", captions, F.lit(keys)).alias("prompt"))


def in_order(points: list[Column], n: Column) -> list[Column]:
    """Points clipped to 1 .. n - 2, each at least one frame after its predecessor."""
    out: list[Column] = []
    for c in points:
        clipped = F.greatest(F.lit(1).cast("long"), F.least(n - 2, c))
        out.append(F.greatest(clipped, out[-1] + 1) if out else clipped)
    return out


def proposed(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(ep, n, points, flags): what replies (request_id, raw_response) say, or the shares where any point is missing or no number."""
    rows = asked.join(answers.select("request_id", "raw_response"), "request_id", "left")
    whole = F.try_parse_json(F.regexp_extract(F.coalesce("raw_response", F.lit("")), r"(?s)\{.*\}", 0))
    said = [F.bround(F.try_variant_get(whole, f"$.{key}", "string").try_cast("double"), 0) for key in KEYS]
    said = [F.when(F.abs(x) < 1e15, x).cast("long") for x in said]  # neither infinite nor no number
    rows = rows.withColumn("_said", F.array(*said)).withColumn("_ok", F.forall("_said", lambda x: x.isNotNull()))
    n = F.col("n")
    raw = [F.when(F.col("_ok"), F.get("_said", F.lit(k))).otherwise((F.lit(p) * n).cast("long")) for k, p in enumerate(SHARES)]
    flags = F.when(F.col("_ok"), F.array().cast("array<string>")).otherwise(F.array(F.lit(FLAG)))
    return rows.select("ep", "n", F.array(*in_order(raw, n)).alias("points"), flags.alias("flags"))


def fused_documents(state: DataFrame, other: DataFrame, tolerance: float, owned: list[int], points: int = 6) -> DataFrame:
    """A document per episode of state (ep, i, c, n): its points after fusion with other and in order, where they come from,
    how far the tracks are apart, which points are for review, and flags for what was done."""
    rows = fusion.fused(state, other, tolerance, owned).withColumnRenamed("c", "value")
    rows = rows.join(state.select("ep", "i", F.col("c").alias("state")), ["ep", "i"])
    part = F.struct("i", "value", "state", "d", "source", "review")
    held = rows.groupBy("ep").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(part)).alias("rows"), F.count("d").alias("both"))
    n, at = F.col("n"), lambda k: F.col("rows")[k]
    clipped = [F.greatest(F.lit(1).cast("long"), F.least(n - 2, at(k)["value"])) for k in range(points)]
    forward = in_order([at(k)["value"] for k in range(points)], n)
    final = [F.least(x, n - 2 - (points - 1 - k)) for k, x in enumerate(forward)]
    used = [F.when(at(k)["source"].eqNullSafe("other") & (at(k)["d"] > tolerance), f"p{k + 1}: vlm-owned but disagrees, used state") for k in range(points)]
    nudged = [F.when(forward[k] != clipped[k], f"nudged p{k + 1} for ordering") for k in range(1, points)]
    alone = F.when(F.col("both") == 0, "no vlm annotation -> all points from state")
    tight = F.when((forward[-1] > n - 2) & (final[0] < 1), "could not fit ordered points in episode")
    flags = F.array_compact(F.array(*used, alone, *nudged, tight))
    listed = lambda c: F.transform("rows", lambda r: r[c])
    review = F.transform(F.filter("rows", lambda r: r["review"]), lambda r: r["i"])
    return held.select(
        F.col("ep").alias("episode_index"), F.col("n").alias("n_frames"), F.lit("fused").alias("annotator"), F.lit(tolerance).alias("tol_frames"), F.array(*final).alias("critical_points"),
        listed("source").alias("sources"), listed("state").alias("state_cps"), listed("d").alias("disagree_frames"), review.alias("review_points"), flags.alias("flags"),
    )
