"""Logs of JSON lines: rows and bad lines with their numbers, and stages in whichever form a record has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.replies import is_json
from episodica.sources.places import numbered

STAGE = "struct<name:string,start:bigint,end:bigint>"
#: Names of the six points, as they are now and as older annotations have them.
POINTS = ("p1_grasp_tube", "p2_start_pour", "p3_release_tube", "p4_grasp_pestle", "p5_start_grind", "p6_lift_pestle")
OLD_POINTS = tuple(p.split("_", 1)[1] for p in POINTS)


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, good) of the lines that are not blank; good: is the line an object?"""
    lines = numbered(spark, path).where("trim(value) <> ''")
    return lines.withColumn("good", is_json(F.col("value")) & F.startswith(F.ltrim("value"), F.lit("{")))


def _strict(rows: DataFrame) -> DataFrame:
    """rows whose value is an error, with file and line, where a line is no object."""
    error = F.raise_error(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" is not a JSON object")))
    return rows.withColumn("value", F.when(F.col("good"), F.col("value")).otherwise(error))


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, numbers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of JSON lines, bad lines as file, line, value), without blank lines.

    With strict the job fails at a bad line, whose file and number the error names. With numbers rows begin with file and
    line. Lines are numbered over all splits of a file; very long files are read in many.
    """
    parsed = _objects(spark, path)
    bad = parsed.where("NOT good").select("file", "line", "value")
    good = _strict(parsed) if strict else parsed.where("good")
    rows = good.select("file", "line", F.from_json("value", schema).alias("row"))
    return rows.select(*(["file", "line"] if numbers else []), "row.*"), bad.limit(0) if strict else bad


def _stage(found: Column) -> Column:
    """One stage of a record, by the fields that it has: start_t or start_frame, else 0; end_t or end_frame, else the start."""
    got = lambda name, kind: F.try_variant_get(found, f"$.{name}", kind)
    name = F.lower(F.trim(F.coalesce(got("name", "string"), F.lit("adjust"))))
    start = F.coalesce(got("start_t", "long"), got("start_frame", "long"), F.lit(0).cast("long"))
    end = F.coalesce(got("end_t", "long"), got("end_frame", "long"), start)
    return F.struct(F.when(name == "", "adjust").otherwise(name).alias("name"), start.alias("start"), end.alias("end"))


def stage_log(spark: SparkSession, path: str) -> DataFrame:
    """(ep, length, rung, stages, file, line): the last line of each episode, by its place in the log.

    stages come from `normalized_stages`, else from `parsed_response.stages`, else they are empty; rung says which. The
    episode is `episode_index`, else `episode`, else -1; the length `episode_length`, else `n_frames`, else 0. A line that
    is no object fails the job and is named. Stages that are no list count as none.
    """
    rows = _strict(_objects(spark, path)).select("file", "line", F.parse_json("value").alias("whole"))
    got = lambda name, kind: F.try_variant_get("whole", f"$.{name}", kind)
    normal, parsed = got("normalized_stages", "array<variant>"), got("parsed_response.stages", "array<variant>")
    whole = got("normalized_stages", "variant")
    given = whole.isNotNull() & ~F.is_variant_null(whole)
    rung = F.when(given, "normalized").when(F.coalesce(F.size(parsed), F.lit(0)) > 0, "parsed").otherwise("none")
    found = F.when(rung == "normalized", normal).when(rung == "parsed", parsed)
    none = F.array().cast(f"array<{STAGE}>")
    held = rows.select(
        F.coalesce(got("episode_index", "long"), got("episode", "long"), F.lit(-1)).alias("ep"),
        F.coalesce(got("episode_length", "long"), got("n_frames", "long"), F.lit(0)).alias("length"),
        rung.alias("rung"), F.coalesce(F.transform(found, _stage), none).alias("stages"), "file", "line",
    )
    whole = F.struct("length", "rung", "stages", "file", "line")
    return held.groupBy("ep").agg(F.max_by(whole, F.struct("file", "line")).alias("last")).select("ep", "last.*")


def drawn(stages: Column, n: Column) -> Column:
    """Stages inside [0, n): starts and ends are clamped, and no end lies before its start."""

    def clamp(s: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(n - 1, s["start"]))
        return F.struct(s["name"].alias("name"), start.alias("start"), F.greatest(start, F.least(n - 1, s["end"])).alias("end"))

    return F.transform(stages, clamp)


def reference_points(names: Column, points: Column) -> Column:
    """The six points in their order, by name where all six are named, also by older names, else by place; null unless six."""
    old = F.create_map(*(F.lit(x) for pair in zip(OLD_POINTS, POINTS) for x in pair))
    said = F.when(F.coalesce(F.size(names), F.lit(0)) > 0, names).otherwise(F.array(*map(F.lit, POINTS)))
    pairs = F.slice(F.arrays_zip(F.transform(said, lambda x: F.coalesce(old[x], x)).alias("name"), points.alias("c")), 1, F.least(F.size(said), F.size(points)))

    def of(name: str) -> Column:  # of a name that stands twice the last one counts
        return F.element_at(F.filter(pairs, lambda p: p["name"] == name), -1)["c"]

    named = F.array(*(of(p) for p in POINTS))
    known = F.transform(pairs, lambda p: p["name"])
    every = F.size(F.array_intersect(known, F.array(*map(F.lit, POINTS)))) == len(POINTS)
    return F.when(F.coalesce(F.size(points), F.lit(0)) == len(POINTS), F.when(every, named).otherwise(points))
