"""Keyframes of annotated episodes, written into the episodes' own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the points, and sets of them by name, counted from 0.
POINTS = ("grasp_tube", "start_pour", "release_tube", "grasp_pestle", "start_grind", "lift_pestle")
PRESETS = {"all": (0, 1, 2, 3, 4, 5), "eventvla4": (1, 2, 4, 5), "pour_grind": (1, 4)}


def chosen(raw: str) -> tuple[int, ...]:
    """Points, counted from 0, of a preset's name or of a list such as 2,3,5, counted from 1; an error for others."""
    if (name := raw.strip().lower()) in PRESETS:
        return PRESETS[name]
    points = [int(x) for x in raw.split(",") if x.strip()]
    if not points or not all(1 <= x <= 6 for x in points):
        raise ValueError(f"points are a list of numbers from 1 to 6, or one of {', '.join(PRESETS)}: {raw!r}")
    return tuple(x - 1 for x in points)


def keyframes(points: Column, which: tuple[int, ...]) -> Column:
    """The chosen ones of an episode's six points, sorted, each once. Fewer than six, or none at all, are an error."""
    some = F.array_sort(F.array_distinct(F.array(*(F.get(points, F.lit(k)) for k in which))))
    count = F.coalesce(F.size(points), F.lit(0))
    error = F.raise_error(F.concat(F.lit("six points are needed, there are "), count.cast("string")))
    return F.when(count < 6, error).otherwise(some)


def inside(frames: Column, length: Column, strict: bool = False) -> tuple[Column, Column]:
    """(frames clipped to [0, length), sorted, each once; those that had to be). Outside is an error if strict."""
    clip = lambda x: F.greatest(F.lit(0), F.least(x, length - 1))
    outside = F.filter(frames, lambda x: (x < 0) | (x >= length))
    kept = F.array_sort(F.array_distinct(F.transform(frames, clip)))
    if strict:
        kept = F.when(F.size(outside) > 0, F.raise_error(F.lit("a keyframe stands outside its episode"))).otherwise(kept)
    return kept, outside


def exported(episodes: DataFrame, annotations: DataFrame, points: str, offset: int = 0, strict: bool = False, alias: bool = True) -> DataFrame:
    """episodes (episode_index, length, ...) with keyframe_steps, warnings and source, from annotations (ep, points, names).

    points are a preset or a list, as chosen() reads them. An episode's annotation is that of episode_index + offset.
    Without one the steps are empty and the source is null, or it is an error if strict. A missing length counts as 0.
    An annotation with fewer than six points is an error; one without names has those of the task. source holds the
    annotation's episode, points as written here, and the annotation's points and names. With alias the steps stand in
    inspect_keyframe_steps too. All columns of episodes stay.
    """
    names = F.when(F.coalesce(F.size("names"), F.lit(0)) > 0, F.col("names")).otherwise(F.array(*map(F.lit, POINTS)))
    found = annotations.select(
        F.col("ep").alias("_of"), keyframes(F.col("points"), chosen(points)).alias("_steps"), F.col("points").alias("_points"), names.alias("_names")
    )
    joined = episodes.join(found, F.col("episode_index") + offset == F.col("_of"), "left")
    if strict:
        error = F.raise_error(F.concat(F.lit("no annotation for episode "), F.col("episode_index").cast("string")))
        joined = joined.withColumn("_steps", F.when(F.col("_of").isNull(), error).otherwise(F.col("_steps")))
    length = F.coalesce(F.col("length"), F.lit(0))
    kept, outside = inside(F.coalesce("_steps", F.array().cast("array<bigint>")), length, strict)
    said = F.transform(
        outside,
        lambda x: F.format_string("episode %d: keyframe %d outside [0,%d); clipped to %d", F.col("episode_index"), x, length, F.greatest(F.lit(0), F.least(x, length - 1))),
    )
    source = F.when(
        F.col("_of").isNotNull(),
        F.struct(F.col("_of").alias("annotation_episode"), F.lit(points).alias("points"), F.col("_points").alias("critical_points"), F.col("_names").alias("critical_names")),
    )
    more = {"keyframe_steps": kept, "warnings": said, "source": source} | ({"inspect_keyframe_steps": kept} if alias else {})
    return joined.withColumns(more).drop("_of", "_steps", "_points", "_names")


def summary(rows: DataFrame) -> DataFrame:
    """One row: episodes, those with keyframes, the numbers of those without an annotation and of those with warnings, joined
    in their order, or null where there are none, and how many of each and warnings there are.

    The report is one row, so its lists stand in one task: eight bytes for each episode that they name.
    """
    ids = lambda on: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(on, F.col("episode_index")))), ","), F.lit(""))
    missing = F.col("source").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.size("keyframe_steps") > 0).alias("with_keyframes"), ids(missing).alias("missing"),
        ids(F.size("warnings") > 0).alias("warnings"), F.count_if(missing).alias("missing_count"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warning_count"),
    )


def remarks(rows: DataFrame) -> DataFrame:
    """(episode_index, remark): each episode without an annotation, and each warning."""
    missing = F.when(F.col("source").isNull(), F.array(F.lit("missing annotation"))).otherwise(F.col("warnings"))
    return rows.select("episode_index", F.explode(missing).alias("remark"))


def wide(points: DataFrame, flags: DataFrame, names: list[str], fps: float) -> DataFrame:
    """A row per episode of (ep, i, c, n): its frames, each point under its name, each part's seconds, and its flags joined."""
    columns = [F.max(F.when(F.col("i") == k, F.col("c"))).alias(f"p{k}_{name}") for k, name in enumerate(names, 1)]
    held = points.groupBy("ep").agg(F.max("n").alias("n_frames"), *columns)
    edges = [F.lit(0), *(F.col(f"p{k}_{name}") for k, name in enumerate(names, 1)), F.col("n_frames")]
    parts = [F.round((b - a) / fps, 2).alias(f"S{k}_s") for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    joined = held.join(flags.select("ep", F.array_join("flags", "|").alias("flags")), "ep", "left")
    return joined.select("ep", "n_frames", *(c for c in held.columns[2:]), *parts, F.coalesce("flags", F.lit("")).alias("flags"))
