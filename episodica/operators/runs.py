"""Runs of a mask (gaps and islands): closing short gaps and finding the longest run of each episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(frames: DataFrame, mask: str) -> DataFrame:
    """(ep, on, first, last, len) of every maximal run of equal mask values."""
    numbered = frames.withColumn("_island", F.col("f") - F.row_number().over(Window.partitionBy("ep", mask).orderBy("f")))
    found = numbered.groupBy("ep", F.col(mask).alias("on"), "_island").agg(F.min("f").alias("first"), F.max("f").alias("last"))
    return found.drop("_island").withColumn("len", F.col("last") - F.col("first") + 1)


def close_gaps(frames: DataFrame, mask: str, gap: int) -> DataFrame:
    """frames whose mask is also true in false runs shorter than gap that touch neither end of the episode."""
    island = F.col("f") - F.row_number().over(Window.partitionBy("ep", mask).orderBy("f"))
    whole = Window.partitionBy("ep", mask, "_island")
    held = frames.withColumn("_island", island).withColumn("_last", F.max("f").over(Window.partitionBy("ep")))
    first, last = F.min("f").over(whole), F.max("f").over(whole)
    fill = ~F.col(mask) & (first > 0) & (last < F.col("_last")) & (last - first + 1 < gap)
    return held.withColumn(mask, F.col(mask) | fill).drop("_island", "_last")


def longest_run(frames: DataFrame, mask: str) -> DataFrame:
    """(ep, s, e) of the longest true run, half-open; the earliest of equal ones; (0, 0) where there is none."""
    best = F.max(F.when(F.col("on"), F.struct("len", (-F.col("first")).alias("back")))).alias("best")
    found = runs(frames, mask).groupBy("ep").agg(best)
    s = F.coalesce(-F.col("best.back"), F.lit(0)).cast("long")
    return found.select("ep", s.alias("s"), (s + F.coalesce("best.len", F.lit(0))).cast("long").alias("e"))
