"""Streams on different clocks: interpolation and nearest timestamps, by windows over the union of both clocks.

`around` cuts an episode into slices of time, so that a very long one is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (ep, t, id) with the last right sample (pt, pv) at or before t and the first (nt, nv) at or after it."""
    both = left.select("ep", "t", "id", F.lit(None).cast("double").alias("v"), F.lit(1).alias("side"))
    both = both.unionByName(right.select("ep", "t", F.lit(None).cast("long").alias("id"), F.col("v").cast("double").alias("v"), F.lit(0).alias("side")))
    back = Window.partitionBy("ep").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    forth = Window.partitionBy("ep").orderBy(F.desc("t"), "side").rowsBetween(Window.unboundedPreceding, 0)
    sample = F.when(F.col("side") == 0, F.struct("t", "v"))
    near = both.withColumn("p", F.last(sample, ignorenulls=True).over(back)).withColumn("q", F.last(sample, ignorenulls=True).over(forth))
    near = near.where("side = 1")
    return near.select("ep", "t", "id", F.col("p.t").alias("pt"), F.col("p.v").alias("pv"), F.col("q.t").alias("nt"), F.col("q.v").alias("nv"))


def interpolated(left: DataFrame, right: DataFrame) -> DataFrame:
    """Linear between the samples, the first or last sample beyond them; null where the episode has no sample."""
    lerp = F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("t") - F.col("pt")) / (F.col("nt") - F.col("pt"))
    v = F.when(F.col("pt").isNull(), F.col("nv")).when(F.col("nt").isNull() | (F.col("nt") == F.col("pt")), F.col("pv")).otherwise(lerp)
    return neighbours(left, right).select("ep", "id", "t", v.alias("v"))


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """The sample of the nearest time; of two as near, the earlier."""
    later = F.col("pt").isNull() | (F.col("nt") - F.col("t") < F.col("t") - F.col("pt"))
    found = neighbours(left, right).withColumn("later", F.coalesce(later, F.lit(False)))
    return found.select("ep", "id", "t", F.when(F.col("later"), F.col("nt")).otherwise(F.col("pt")).alias("rt"), F.when(F.col("later"), F.col("nv")).otherwise(F.col("pv")).alias("v"))


def around(left: DataFrame, right: DataFrame, slice_width: float | None = None) -> DataFrame:
    """left (ep, t, id) with p, the last right sample (t, v) before t, and q, the first one at or after it.

    Of samples with the same time, p is the one with the largest v and q that with the smallest. With slice_width an
    episode is dealt to tasks in slices of that much time; the samples nearest to a slice come from a table with a row for
    each slice that has any rows, over which windows carry the last sample before it and the first one behind it.
    """
    slice_ = F.lit(0).cast("long") if slice_width is None else F.floor(F.col("t") / slice_width)
    both = left.select("ep", "t", "id", F.lit(None).cast("long").alias("v"), F.lit(1).alias("side"))
    both = both.unionByName(right.select("ep", "t", F.lit(None).cast("long").alias("id"), F.col("v").cast("long").alias("v"), F.lit(0).alias("side")))
    both = both.withColumn("slice", slice_)
    sample = F.when(F.col("side") == 0, F.struct("t", "v"))
    mine = Window.partitionBy("ep", "slice")
    back = mine.orderBy("t", F.desc("side"), "v").rowsBetween(Window.unboundedPreceding, 0)
    forth = mine.orderBy(F.desc("t"), "side", F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("p", F.last(sample, ignorenulls=True).over(back)).withColumn("q", F.last(sample, ignorenulls=True).over(forth)).where("side = 1")
    if slice_width is not None:
        ends = both.groupBy("ep", "slice").agg(F.max(sample).alias("hi"), F.min(sample).alias("lo"))
        by_slice = Window.partitionBy("ep").orderBy("slice")
        carried = ends.select(
            "ep", "slice", F.last("hi", ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
            F.first("lo", ignorenulls=True).over(by_slice.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
        )
        near = near.join(carried, ["ep", "slice"]).withColumns({"p": F.coalesce("p", "before"), "q": F.coalesce("q", "after")})
    return near.select("ep", "t", "id", "p", "q")


def nearest_sample(left: DataFrame, right: DataFrame, slice_width: float | None = None) -> DataFrame:
    """(ep, id, t, rt, v): the right sample with the nearest time; of two as near, the earlier."""
    found = around(left, right, slice_width)
    earlier = F.col("q").isNull() | (F.col("t") - F.col("p.t") <= F.col("q.t") - F.col("t"))
    best = F.when(F.coalesce(earlier, F.lit(False)), F.col("p")).otherwise(F.col("q"))
    return found.withColumn("best", best).select("ep", "id", "t", F.col("best.t").alias("rt"), F.col("best.v").alias("v"))


def _clock(times: DataFrame, unit: float) -> DataFrame:
    """(ep, n, first, span, rows of it) of times (ep, place, t): how many, the first, and the time from the first to the last, in seconds."""
    held = times.groupBy("ep").agg(F.count(F.lit(1)).alias("held"), F.min_by("t", "place").alias("first"), F.max_by("t", "place").alias("last"))
    return held.select("ep", "held", "first", ((F.col("last") - F.col("first")) / unit).alias("span"))


def matched(hands: DataFrame, times: DataFrame, videos: DataFrame, stamps: DataFrame, offset_s: float = 0.0, fps: float = 60.0, mode: str = "elapsed", slice_s: float = 600.0) -> DataFrame:
    """(ep, f, at): for each frame f of a hand's camera the frame of the headset's video at the same time.

    hands (ep, n) and videos (ep, frames) say how many frames there are, times (ep, place, t) the hand frames' seconds,
    stamps (ep, place, t) the video frames' nanoseconds. Hand times count if there are two or more that grow, else frames
    are 1 / fps apart; stamps count if there are as many as frames and they grow. If so and mode is `elapsed`, the nearest
    time since each stream's start is taken, the hand's plus offset_s; else both streams are stretched onto 0 to 1; without
    stamps frames are spaced evenly, halves to even. Episodes without a video have no rows.
    """
    hand, ego = _clock(times, 1.0), _clock(stamps, 1e9)
    whole = hands.join(videos, "ep").where("n > 0 AND frames > 0")
    whole = whole.join(hand.select("ep", F.col("first").alias("hand_first"), "held", F.col("span").alias("hand_span")), "ep", "left")
    whole = whole.join(ego.select("ep", F.col("first").alias("ego_first"), F.col("held").alias("stamped"), F.col("span").alias("ego_span")), "ep", "left")
    timed = F.coalesce((F.col("held") >= 2) & (F.col("hand_span") > 0), F.lit(False))
    whole = whole.withColumns({"timed": timed, "stamped": F.coalesce((F.col("stamped") == F.col("frames")) & (F.col("ego_span") > 0), F.lit(False))})
    frames = whole.withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    frames = frames.join(times.select("ep", F.col("place").alias("f"), "t"), ["ep", "f"], "left")
    he = F.when(F.col("timed"), F.col("t") - F.col("hand_first")).otherwise(F.col("f") / fps)
    last = F.when(F.col("timed"), F.col("hand_span")).otherwise((F.col("n") - 1) / fps)
    rel = F.when(last > 0, he / last).otherwise(0.0)
    straight = F.lit(mode == "elapsed")
    left = frames.where("stamped").select("ep", F.when(straight, he + offset_s).otherwise(rel).alias("t"), F.col("f").alias("id"))
    scale = F.when(straight, F.lit(1.0)).otherwise(F.col("ego_span"))
    right = stamps.join(whole.where("stamped").select("ep", "ego_first", "ego_span"), "ep").select("ep", ((F.col("t") - F.col("ego_first")) / 1e9 / scale).alias("t"), F.col("place").alias("v"))
    found = nearest_sample(left, right, slice_s if mode == "elapsed" else 1 / 64).select("ep", F.col("id").alias("f"), F.col("v").alias("at"))
    even = frames.where("NOT stamped").select("ep", "f", F.bround(rel * (F.col("frames") - 1), 0).cast("long").alias("at"))
    return found.unionByName(even)


def alignment_report(hands: DataFrame, times: DataFrame, videos: DataFrame, stamps: DataFrame, starts: DataFrame, offset_s: float = 0.0, fps: float = 60.0, mode: str = "elapsed") -> DataFrame:
    """A row per episode of hands: is there a video, how long are both streams, which of its frames are used, how far are the clocks apart.

    starts (ep, unix_us, ticks_us) says when the headset's session began, by both of its clocks. The clocks' distance needs
    that, the hand's times and stamps that fit the video.
    """
    hand, ego = _clock(times, 1.0), _clock(stamps, 1e9)
    used = matched(hands, times, videos, stamps, offset_s, fps, mode).groupBy("ep").agg(F.min("at").alias("ego_first_used"), F.max("at").alias("ego_last_used"))
    rows = hands.join(videos, "ep", "left").join(used, "ep", "left").join(starts, "ep", "left")
    rows = rows.join(hand.select("ep", F.col("first").alias("hand_first"), "held", F.col("span").alias("hand_span")), "ep", "left")
    rows = rows.join(ego.select("ep", F.col("first").alias("ego_first"), F.col("held").alias("stamped"), F.col("span").alias("ego_span")), "ep", "left")
    ok = F.coalesce(F.col("frames"), F.lit(0)) > 0
    timed = F.coalesce((F.col("held") >= 2) & (F.col("hand_span") > 0), F.lit(False))
    fits = F.coalesce((F.col("stamped") == F.col("frames")) & (F.col("ego_span") > 0), F.lit(False))
    began = F.col("unix_us") / 1e6 + (F.col("ego_first") / 1e9 - F.col("ticks_us") / 1e6)
    known = ok & fits & (F.coalesce("held", F.lit(0)) > 0) & (F.coalesce("unix_us", F.lit(0)) != 0) & (F.coalesce("ticks_us", F.lit(0)) != 0)
    length = F.when(timed, F.col("hand_span")).otherwise((F.col("n") - 1) / fps)
    return rows.select(
        "ep", ok.alias("ok"), F.when(~ok, "no ego video").alias("reason"), F.when(ok, F.lit(mode)).alias("mode"), F.when(ok, F.lit(offset_s)).alias("offset_s"),
        F.when(ok, F.col("n")).alias("hand_frames"), F.when(ok, F.round(length, 3)).alias("hand_dur_s"), F.when(ok, F.col("frames")).alias("ego_frames"),
        F.when(ok & fits, F.round("ego_span", 3)).alias("ego_dur_s"), F.when(known, F.round(began - F.col("hand_first"), 1)).alias("device_clock_offset_s"),
        "ego_first_used", "ego_last_used",
    )
