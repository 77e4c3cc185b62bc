"""Onsets seen in images: energies of frame differences, smoothed, and the longest spell of high energy in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import arrays, signal


def smoothed(rows: DataFrame, seconds: float = 0.15, fps: float = 60) -> DataFrame:
    """rows (ep, f, energy, ...) with energy as the sum over the frames of some seconds, an odd number of them.

    A sum and not a mean, so that whole numbers stay whole; the onset does not depend on the unit.
    """
    return rows.withColumn("energy", signal.smooth_sum(F.col("energy"), int(seconds * fps) | 1))


def onsets(rows: DataFrame, windows: DataFrame, fps: float, frac: float = 0.5, gap_s: float = 0.5, least_s: float = 0.4) -> DataFrame:
    """(ep, onset, ok) for each window (ep, lo, hi) over frames (ep, f, energy): where high energy begins for long.

    High is above the share frac of the way from the window's least energy to its 90th percentile; gaps shorter than gap_s
    count as high. A window of fewer than three frames or without energy, and a spell shorter than least_s, give a quarter
    of the window and are not ok.
    """
    held = rows.join(windows, "ep").where((F.col("f") >= F.col("lo")) & (F.col("f") < F.col("hi")))
    held = held.groupBy("ep").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "energy"))), lambda x: x["energy"]).alias("v"))
    held = windows.join(held, "ep", "left")
    limit = arrays.let(F.col("v"), lambda v: F.array_min(v) + frac * (arrays.percentile(v, 0.9) - F.array_min(v)))
    high = arrays.let(limit, lambda k: F.transform("v", lambda x: x > k))
    held = held.withColumn("run", arrays.hold(high, int(gap_s * fps)))
    flat = (F.coalesce(F.size("v"), F.lit(0)) < 3) | ~F.coalesce(F.array_max("v") > 0, F.lit(False))
    ok = ~flat & (F.col("run.e") - F.col("run.s") >= int(least_s * fps))
    ok = F.coalesce(ok, F.lit(False))
    quarter = F.col("lo") + (F.lit(0.25) * (F.col("hi") - F.col("lo"))).cast("long")
    return held.select("ep", F.when(ok, F.col("lo") + F.col("run.s")).otherwise(quarter).cast("long").alias("onset"), ok.alias("ok"))


def with_roles(rows: DataFrame) -> DataFrame:
    """rows (flags, holder, wiper, ...) whose flags end with who holds and who wipes."""
    roles = F.array(F.concat(F.lit("holder="), "holder"), F.concat(F.lit("wiper="), "wiper"))
    return rows.withColumn("flags", F.concat("flags", roles))


def needs_review(flags: Column) -> Column:
    """Is there any flag that does not just say who holds and who wipes?"""
    return F.exists(flags, lambda x: ~x.rlike("^(holder|wiper)="))
