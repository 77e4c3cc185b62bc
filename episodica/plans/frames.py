"""Stand-ins for episodes in the driver's tables: users are episodes, their events are frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.functions import signal
from episodica.operators import intervals, runs, segment
from episodica.sources.scratch import cut

#: What the seven parts of an episode are taken for where stages are scored.
STAGE_OF = ("reach", "transport", "place", "release", "grasp", "adjust", "done")
#: Ten frames a second make the reference's times whole frames of episodes as short as these.
TASK, WIPE = segment.Hold(fps=10), segment.Wipe(fps=10)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ep, f, n, a, b, us, kind): two integer signals and the time in microseconds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("ep"),
        (F.row_number().over(order) - 1).cast("long").alias("f"),
        F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"),
        F.round(F.col("value") * 100).cast("long").alias("a"),
        F.get_json_object("props", "$.k").cast("long").alias("b"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_type").alias("kind"),
    )


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    for x in "ab":
        low, high = (F.round(signal.share_of(F.col(x), p), 6) for p in (0.01, 0.99))
        rows = rows.withColumns({f"{x}1": low, f"{x}99": high})
        rows = rows.withColumn(f"g{x}", signal.norm01(F.col(x), F.col(f"{x}1"), F.col(f"{x}99")))
    return rows


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normed(spark, sf_dir)
    rows = rows.withColumns({f"r{x}": signal.rest(F.col(f"g{x}")) for x in "ab"})
    return rows.withColumns({f"c{x}": F.abs(F.col(f"g{x}") - F.col(f"r{x}")) > 0.35 for x in "ab"})


def hold(spark: SparkSession, sf_dir: str, x: str) -> DataFrame:
    """(ep, s, e) of the longest time for which signal x is away from rest."""
    return runs.longest_run(runs.close_gaps(masked(spark, sf_dir), f"c{x}", 3), f"c{x}")


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with two grippers and a position, made so that most episodes hold, pour and grind, and some do not.

    tube closes in the first half unless ep % 11 = 0, pestle in the second unless ep % 13 = 0, hand nearly throughout; the
    position rests while the tube is poured and shakes in place while the pestle grinds, unless ep % 7 = 0. Events add noise.
    """
    part = lambda low, high: (F.col("f") * 100 >= F.col("n") * low) & (F.col("f") * 100 < F.col("n") * high)
    ep, f = F.col("ep"), F.col("f")
    tube = F.when(part(14 + ep % 6, 42 + ep % 5) & (ep % 11 != 0), 300).otherwise(1000) + F.col("b") % 20
    hand = F.when(part(14 + ep % 6, 95) & (ep % 11 != 0), 300).otherwise(1000) + F.col("b") % 20
    pestle = F.when(part(50 + ep % 4, 90 + ep % 4) & (ep % 13 != 0), 300).otherwise(1000) + F.col("a") % 20
    at = F.when(part(28, 42), F.floor(F.col("n") * 28 / 100) * 30).when(part(60, 85) & (ep % 7 != 0), 2000 + (f % 2) * 120).otherwise(f * 30)
    return frames(spark, sf_dir).withColumns({"tube": tube, "pestle": pestle, "hand": hand, "x": at.cast("long") + F.col("b") % 7, "y": (f * 5 + F.col("a") % 9).cast("long")})


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.motion(moved(spark, sf_dir), ["x", "y"], *TASK.widths())


_SEGMENTED: dict[tuple, DataFrame] = {}


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan for all queries of a session: building its expressions takes longer than running them on small tables.

    Plans are kept for the running application alone, and for the files that the table has at the time.
    """
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, *sorted(events(spark, sf_dir).inputFiles()))
    if key not in _SEGMENTED:
        for old in [k for k in _SEGMENTED if k[:2] != key[:2] or k[2] == sf_dir]:
            del _SEGMENTED[old]
        _SEGMENTED[key] = segment.held_tasks(motion(spark, sf_dir), TASK)
    return _SEGMENTED[key]


def wiped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left hand holds what the right one wipes; the position is that of both, and the right one also nods."""
    rows = moved(spark, sf_dir).withColumn("z", (F.col("f") % 3) * 10 + F.col("b") % 4)
    for side, dims in (("left", ["x", "y"]), ("right", ["x", "y", "z"])):
        rows = segment.motion(rows, dims, *WIPE.widths(), zscore=False).withColumnsRenamed({"raw": f"{side}_raw", "drift": f"{side}_drift"})
    return segment.wiped(rows.withColumnsRenamed({"hand": "left", "pestle": "right"}), WIPE)


def state_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ep, i, c, n): the six points of each episode.

    posexplode would have the optimizer push its test for empty arrays, points and all, below every step of the
    segmentation; the outer form, which has no such test, gives the same rows, as there are always six.
    """
    rows = segmented(spark, sf_dir).select("ep", "n", F.posexplode_outer("cps").alias("i", "c"))
    return rows.select("ep", (F.col("i") + 1).cast("long").alias("i"), "c", "n")


def points_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state_points for queries that use them more than once: the segmentation runs once."""
    return cut(state_points(spark, sf_dir))


def other_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second track: the state's points, moved by what signal b says at frame 5 i; episodes divisible by 7 have none."""
    at = frames(spark, sf_dir).select("ep", F.col("f").alias("at"), "b")
    rows = state_points(spark, sf_dir).withColumn("at", F.col("i") * 5).join(at, ["ep", "at"]).where("ep % 7 <> 0")
    moved = F.greatest(F.lit(0), F.least(F.col("c") + F.col("b") % 21 - 10, F.col("n") - 1))
    return rows.select("ep", "i", moved.cast("long").alias("c"), "n")


def proposed_stages(spark: SparkSession, sf_dir: str, points: DataFrame | None = None) -> DataFrame:
    """(ep, i, first, last, n): the subtasks with ends that overlap, leave gaps or leave the episode."""
    at = frames(spark, sf_dir).select("ep", F.col("f").alias("at"), "b")
    parts = intervals.subtasks(points or state_points(spark, sf_dir)).withColumn("i", F.col("k") + 1).withColumn("at", F.col("i") * 3)
    rows = parts.join(at, ["ep", "at"])
    return rows.select("ep", "i", (F.col("first") + F.col("b") % 5 - 2).alias("first"), (F.col("last") + F.col("b") % 7 - 3).alias("last"), "n")
