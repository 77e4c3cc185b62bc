"""Ordered points and the intervals between them. Points are rows (ep, i, c, n): i from 1, frame c, n frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_point() -> WindowSpec:
    return Window.partitionBy("ep").orderBy("i")


def so_far() -> WindowSpec:
    return by_point().rowsBetween(Window.unboundedPreceding, 0)


def repair_forward(clip: bool = False) -> Column:
    """Each point at least one frame after its predecessor."""
    c = F.least(F.greatest("c", F.lit(1)), F.col("n") - 2) if clip else F.col("c")
    return F.col("i") + F.max(c - F.col("i")).over(so_far())


def repair(points: int) -> Column:
    """Strictly increasing points in 1 .. n - 2: moved forward first, then back from the end."""
    return F.least(repair_forward(clip=True), F.col("n") - 2 - (points - F.col("i")))


def subtasks(points: DataFrame) -> DataFrame:
    """(ep, k, first, last): from each point to the frame before the next one; the first begins at 0, the last ends at n - 1."""
    zero = points.groupBy("ep").agg(F.max("n").alias("n")).select("ep", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("c"), "n")
    both = zero.unionByName(points.select("ep", F.col("i").cast("long").alias("i"), F.col("c").cast("long").alias("c"), "n"))
    last = F.coalesce(F.lead("c").over(by_point()) - 1, F.col("n") - 1)
    return both.select("ep", F.col("i").alias("k"), F.col("c").alias("first"), last.alias("last"), "n")


def stages(points: DataFrame) -> DataFrame:
    """(ep, k, first, last) by the other convention: a point is the last frame of the stage before it."""
    parts = subtasks(points)
    n, k = F.col("n"), F.col("k")
    first = F.when(k == 0, F.col("first")).otherwise(F.col("first") + 1)
    last = F.when(F.col("last") == n - 1, F.col("last")).otherwise(F.col("last") + 1)
    return parts.select("ep", "k", first.alias("first"), F.greatest(first, last).alias("last"), "n")


def dense(intervals: DataFrame) -> DataFrame:
    """One row per frame of each interval."""
    return intervals.where("last >= first").select("ep", F.explode(F.sequence("first", "last")).alias("f"), "k")


def normalised(items: DataFrame) -> DataFrame:
    """Makes a list of (ep, i, first, last, n), i from 1, contiguous: ends move forward, the final end is n - 1."""
    c = F.least("last", F.col("n") - 1)
    end = F.col("i") + F.max(c - F.col("i")).over(so_far())
    final = F.max("i").over(Window.partitionBy("ep"))
    ended = items.withColumn("end", F.when(F.col("i") == final, F.col("n") - 1).otherwise(F.least(end, F.col("n") - 1)))
    begun = ended.withColumn("start", F.coalesce(F.lag("end").over(by_point()) + 1, F.lit(0).cast("long")))
    return begun.where(F.col("start") < F.col("n")).where("end >= start").select("ep", "i", "start", "end", "n")


def coverage(items: DataFrame) -> DataFrame:
    """Per episode: are the intervals contiguous, inside the episode, and does the last end at n - 1?"""
    before = F.coalesce(F.lag("last").over(by_point()), F.lit(-1))
    ok = (F.col("first") == before + 1) & (F.col("last") >= F.col("first")) & (F.col("last") < F.col("n"))
    held = items.withColumn("ok", ok)
    whole = F.bool_and("ok") & (F.max_by("last", "i") == F.max("n") - 1)
    return held.groupBy("ep").agg(whole.alias("covered"), F.count(F.lit(1)).alias("parts"))


def interval_score(items: DataFrame) -> DataFrame:
    """1 - (uncovered + doubly covered + outside frames) / n, at least 0. Interval ends are swept, frames are not listed."""
    inside = items.select("ep", "n", F.greatest("first", F.lit(0)).alias("a"), F.least("last", F.col("n") - 1).alias("b"), "first", "last")
    order = Window.partitionBy("ep").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(order) + 1, F.col("a"))) + 1, F.lit(0))
    size = F.greatest(F.col("b") - F.col("a") + 1, F.lit(0))
    out = F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)) - size
    held = inside.withColumns({"fresh": fresh, "size": size, "outside": out})
    bad = F.max("n") - F.sum("fresh") + F.sum("size") - F.sum("fresh") + F.sum("outside")
    return held.groupBy("ep").agg(F.round(F.greatest(F.lit(0.0), 1 - bad / F.max("n")), 4).alias("score"))


def normalised_stages(items: DataFrame) -> DataFrame:
    """Per episode of (ep, i, name, stage, first, last, bad, n) the contiguous list of its stages, and what had to be changed.

    name is as said, stage what it counts as. A missing start is the end before plus one, a missing end the start as said;
    an item of which a time is given but is no number (bad) is one frame after the end before. Ends of all but the final
    item are clamped without a word; the final one ends at n - 1. Items from the first one on that would start behind the
    episode are left out. An episode without a stage is one stage `global`.

    stages: structs of name, start, end, original (the name as said, where it counts as another); changed: whether any
    start or name, the final end or the number of stages differs from what was said, or a time was no number; renamed: how
    many names changed, the first item that starts behind the episode among them; coverage_ok, stage_count: of stages.
    """
    n, i = F.col("n"), F.col("i")
    some = items.where("i IS NOT NULL").withColumn("final", i == F.max("i").over(Window.partitionBy("ep")))
    bad = F.coalesce(F.col("bad"), F.lit(False))
    rows = some.withColumns({"bad": bad, "first": F.when(~bad, F.col("first")), "last": F.when(~bad, F.coalesce("last", "first"))})
    # The end as said moves forward over all ends before it; without one an item takes one frame.
    c = F.least(F.coalesce("last", F.lit(-(1 << 40)).cast("long")), n - 1)
    rows = rows.withColumn("reach", i - 1 + F.greatest(F.lit(0), F.max(c - (i - 1)).over(so_far())))
    rows = rows.withColumn("start", F.coalesce(F.lag("reach").over(by_point()) + 1, F.lit(0).cast("long")))
    rows = rows.withColumn("kept", F.col("start") < n)
    rows = rows.withColumn("seen", F.coalesce(F.lag("kept").over(by_point()), F.lit(True)))  # what follows the first item behind the episode is not looked at
    end = F.when(F.col("final"), n - 1).otherwise(F.least("reach", n - 1))
    renamed = ~F.col("name").eqNullSafe(F.col("stage"))
    moved = F.coalesce(F.col("first"), F.col("start")) != F.col("start")
    cut = F.col("final") & (F.coalesce("last", "start") != n - 1)
    part = F.struct("i", F.col("stage").alias("name"), "start", end.alias("end"), F.when(renamed, F.col("name")).alias("original"))
    held = rows.groupBy("ep").agg(
        F.sort_array(F.collect_list(F.when(F.col("kept"), part))).alias("stages"),
        F.count_if(renamed & F.col("seen")).alias("renamed"),
        F.bool_or(F.col("seen") & (moved | cut | renamed | F.col("bad") | ~F.col("kept"))).alias("changed"),
    )
    every = items.groupBy("ep").agg(F.max("n").alias("n"))
    found = every.join(held, "ep", "left").withColumn("none", F.coalesce(F.size("stages"), F.lit(0)) <= 0)
    kind = "struct<name:string,start:bigint,end:bigint,original:string>"
    alone = F.array(F.struct(F.lit("global"), F.lit(0), n - 1, F.lit(None))).cast(f"array<{kind}>")
    last = F.size("stages") - 1
    whole = lambda x, k: F.struct(x["name"], x["start"], F.when(k == last, n - 1).otherwise(x["end"]), x["original"]).cast(kind)
    found = found.withColumn("stages", F.when(F.col("none"), alone).otherwise(F.transform("stages", whole)))
    follows = F.forall(F.transform("stages", lambda x, k: x["start"] == F.when(k == 0, F.lit(0)).otherwise(F.get("stages", k - 1)["end"] + 1)), lambda ok: ok)
    covered = follows & (F.element_at("stages", -1)["end"] == n - 1)
    return found.select(
        "ep", "n", "stages", (F.col("none") | F.col("changed")).alias("changed"), F.coalesce("renamed", F.lit(0).cast("long")).alias("renamed"),
        covered.alias("coverage_ok"), F.size("stages").cast("long").alias("stage_count"),
    )
