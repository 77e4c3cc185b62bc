"""Several annotation tracks, point by point: owners, tolerances, review, priorities and move decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fused(state: DataFrame, other: DataFrame, tolerance: float, owned: list[int], fall_back: bool = True) -> DataFrame:
    """state and other are (ep, i, c, n); other owns the points in owned. A disagreement above the tolerance is for review.

    With fall_back an owned point that disagrees takes the state value; without the other track all is state and review.
    """
    joined = state.join(other.select("ep", "i", F.col("c").alias("v")), ["ep", "i"], "left")
    d = F.abs(F.col("v") - F.col("c"))
    mine = F.col("i").isin(owned) & F.col("v").isNotNull()
    value = F.when(mine & ((d <= tolerance) if fall_back else F.lit(True)), F.col("v")).otherwise(F.col("c"))
    review = F.when(F.col("v").isNull(), F.lit(True)).otherwise(d > tolerance)
    source = F.when(mine, "other").otherwise("state")
    return joined.select("ep", "i", value.alias("c"), "n", d.alias("d"), source.alias("source"), review.alias("review"))


def merged_onset(pose: Column, vision: Column, tolerance: float) -> tuple[Column, Column]:
    """(frame, source): the half-even mean where both agree, else vision, marked for review; whichever exists alone."""
    agree = F.abs(pose - vision) <= tolerance
    frame = F.when(agree, F.bround((pose + vision) / 2, 0).cast("long")).otherwise(F.coalesce(vision, pose))
    source = F.when(agree, "pose+vision").when(vision.isNotNull() & pose.isNotNull(), "vision(review)").when(vision.isNotNull(), "vision").when(pose.isNotNull(), "pose")
    return frame, source


def decision(confidence: Column, delta: Column, evidence: Column, i: Column, most: int, least: int) -> Column:
    """Why a proposed move is refused, by the first reason that holds, or `accepted`."""
    return (
        F.when(confidence != "high", "confidence_not_high")
        .when(F.abs(delta) > most, "move_too_large")
        .when(F.coalesce(F.trim(evidence), F.lit("")) == "", "missing_evidence")
        .when(i != 2, "record_only_non_p2")
        .when(F.abs(delta) < least, "move_too_small")
        .otherwise("accepted")
    )


def confidence(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("high"), "high").when(low.contains("med"), "medium").otherwise("low")


def spaced(low: Column, high: Column, n: int) -> Column:
    """n evenly spaced whole numbers from low to high, halves to even; low alone for n = 1."""
    if n == 1:
        return F.array(low)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(low + k * ((high - low) / F.lit(float(n - 1))), 0).cast("long"))


def nearest_of(frames: Column, to: Column) -> Column:
    """The candidate nearest to a frame; the smaller of two as near."""
    return F.array_min(F.transform(frames, lambda x: F.struct(F.abs(x - to).alias("d"), x.alias("x"))))["x"]


def complete(points: Column, size: int = 6) -> Column:
    """The points if there are exactly `size`, else null."""
    return F.when(F.size(points) == size, points)


def first_of(tracks: dict[str, DataFrame], size: int = 6) -> DataFrame:
    """(ep, source, points) of every episode: the first track, in the order given, that has exactly `size` points."""
    joined = None
    for name, track in tracks.items():
        mine = track.select("ep", complete(F.col("points"), size).alias(f"points of {name}"))
        joined = mine if joined is None else joined.join(mine, "ep", "full")
    source = F.coalesce(*(F.when(F.col(f"points of {t}").isNotNull(), F.lit(t)) for t in tracks))
    return joined.select("ep", source.alias("source"), F.coalesce(*(F.col(f"points of {t}") for t in tracks)).alias("points"))


def matched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of left with those of right that have the same key, rows of left without one)."""
    return left.join(right, key), left.join(right, key, "left_anti")
