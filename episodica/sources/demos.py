"""Folders of recordings: which are whole, their grippers and frame times joined by position, their clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.functions.replies import is_json
from episodica.sources import small_files
from episodica.sources.places import placed, side_by_side

#: What a recording must have, what marks a folder as one, and frames a second where no times are known.
REQUIRED = ("gripper_width_left.csv", "gripper_width_right.csv")
MARKS = ("left_hand_timestamps.csv", "right_hand_timestamps.csv")
DEFAULT_FPS = 60.0


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(demo, name, size) of all files below root: the folder next to root, and the path in it. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z0-9]+:/*", "/")
    inner = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), F.concat(F.lit(r"^\Q"), base, F.lit(r"\E/")), F.lit(""))
    parts = files.select(F.split(inner, "/", 2).alias("p"), "length").where(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias("demo"), F.col("p")[1].alias("name"), F.col("length").alias("size"))


def scanned(files: DataFrame) -> DataFrame:
    """(demo, valid, reason, video) of each folder of a listing that is a recording, whole or not.

    A folder with all required files is valid. One that lacks some but has a mark is incomplete, and the reason names what
    is missing. Other folders are left out. video is the first ego video: next to ego_data, else in a folder below it.
    """
    bit = F.lit(0)
    for k, name in enumerate((*REQUIRED, *MARKS)):
        bit = F.when(F.col("name") == name, 1 << k).otherwise(bit)
    depth = F.when(F.col("name").rlike(r"^ego_data/[^/]+\.mp4$"), 1).when(F.col("name").rlike(r"^ego_data/.+\.mp4$"), 2)
    video = F.when(depth.isNotNull(), F.struct(depth.alias("depth"), F.col("name").alias("name")))
    held = files.groupBy("demo").agg(F.bit_or(bit).alias("has"), F.min(video).alias("video"))
    lacks = [F.when(F.col("has").bitwiseAND(1 << k) == 0, F.lit(name)) for k, name in enumerate(REQUIRED)]
    valid = F.col("has").bitwiseAND((1 << len(REQUIRED)) - 1) == (1 << len(REQUIRED)) - 1
    marked = F.col("has") >= 1 << len(REQUIRED)
    reason = F.when(~valid, F.concat(F.lit("missing "), F.array_join(F.array_compact(F.array(*lacks)), ", ")))
    return held.where(valid | marked).select("demo", valid.alias("valid"), reason.alias("reason"), F.col("video.name").alias("video"))


def column_of(spark: SparkSession, path: str, column: str, demo: str, alias: str) -> DataFrame:
    """(demo, place, alias): a column of CSV files without keys, by its name in the header, and its rows' places.

    demo is a pattern whose first group is the recording's name in the file's path.
    """
    rows = placed(spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).select(F.col(column).cast("double").alias(alias)))
    return rows.select(F.regexp_extract("file", demo, 1).alias("demo"), "place", alias)


def columns_of(spark: SparkSession, root: str, wanted: dict[str, str]) -> DataFrame:
    """(demo, file, place, value): columns of very many CSV files without keys in one pass; wanted names a column for each file.

    A recording is named by the folder that its files are in. Each file is one task's; column_of reads a long one in many.
    """
    rows = small_files.columns(spark, root, wanted)
    return rows.select(F.element_at(F.split("folder", "/"), -1).alias("demo"), "file", "place", F.col("value").cast("double").alias("value"))


def stamps_of(spark: SparkSession, path: str, demo: str) -> DataFrame:
    """(demo, place, t): `timestamp_ns` of JSON lines, counted without the lines that have none or are no JSON."""
    stamp = F.try_variant_get(F.try_parse_json("value"), "$.timestamp_ns", "long")
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(is_json(F.col("value")) & stamp.isNotNull())
    return placed(lines.select(stamp.alias("t"))).select(F.regexp_extract("file", demo, 1).alias("demo"), "place", "t")


def stamps_in(spark: SparkSession, root: str) -> DataFrame:
    """(demo, place, t): what stamps_of gives, of very many files below root; a recording is named by its file's folder.

    Each file is one task's; stamps_of reads a long one in many.
    """
    stamp = F.try_variant_get(F.try_parse_json("value"), "$.timestamp_ns", "long")
    lines = small_files.lines(spark, root).where(is_json(F.col("value")) & stamp.isNotNull())
    place = (F.row_number().over(Window.partitionBy("demo", "name").orderBy("line")) - 1).cast("long")
    rows = lines.select(F.element_at(F.split("name", "/"), -2).alias("demo"), "name", "line", stamp.alias("t"))
    return rows.select("demo", place.alias("place"), "t")


def grippers(left: DataFrame, right: DataFrame) -> DataFrame:
    """(demo, place, left, right) from (demo, place, width) of both hands: the longer side is cut to the shorter."""
    return side_by_side(left.withColumnRenamed("width", "left"), right.withColumnRenamed("width", "right"), ["demo"])


def frame_times(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """(demo, place, t): of times (demo, side, place, t) the left side's, else the right's, whichever has a time for each frame."""
    frames = pairs.groupBy("demo").agg(F.count(F.lit(1)).alias("n"))
    sides = times.groupBy("demo", "side").agg(F.count(F.lit(1)).alias("held")).join(frames, "demo").where("held >= n")
    first = sides.groupBy("demo").agg(F.min("side").alias("side"), F.max("n").alias("n"))  # left sorts before right
    return times.join(first, ["demo", "side"]).where("place < n").select("demo", "place", "t")


def rates(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """(demo, n, fps): frames a second by the first and last frame's times, DEFAULT_FPS without times or between equal ones."""
    return with_rates(pairs.groupBy("demo").agg(F.count(F.lit(1)).alias("n")), times)


def with_rates(frames: DataFrame, times: DataFrame) -> DataFrame:
    """frames (demo, n, ...), a row for each recording, with fps, by the times that frame_times would choose.

    Only the ends of each side's times are kept, so all is grouped by recording and neither table is read twice.
    """
    kept = [c for c in frames.columns if c != "demo"]
    at = F.when(F.col("place") < F.col("n"), F.col("place"))
    sides = frames.join(times, "demo", "left").groupBy("demo", "side")
    sides = sides.agg(*(F.first(c).alias(c) for c in kept), F.count("place").alias("_held"), (F.max_by("t", at) - F.min_by("t", at)).alias("_span"))
    span = F.min_by("_span", F.when(F.col("_held") >= F.col("n"), F.col("side")))  # left sorts before right
    rows = sides.groupBy("demo").agg(*(F.first(c).alias(c) for c in kept), span.alias("_span"))
    fps = F.when(F.col("n") >= 2, (F.col("n") - 1) / F.nullif(F.col("_span"), F.lit(0.0)))
    return rows.select("demo", *kept, F.coalesce(fps, F.lit(DEFAULT_FPS)).alias("fps"))


def by_place(rows: DataFrame, name: str, places: list[int]) -> DataFrame:
    """Rows whose `name` stands at one of the places, from 0, in the sorted list of all names, with `place`.

    Only as many names are sorted out as the last place asks for.
    """
    last = max(places, default=-1) + 1
    names = rows.select(name).distinct().orderBy(name).limit(last)
    kept = names.withColumn("place", (F.row_number().over(Window.orderBy(name)) - 1).cast("long")).where(F.col("place").isin(places))
    return rows.join(F.broadcast(kept), name)


def elapsed(t: Column, demo: str = "demo", place: str = "place") -> Column:
    """Time since the first row of the recording."""
    return t - F.first(t).over(Window.partitionBy(demo).orderBy(place))
