"""The stage layer of an episode: what a model is told, what its reply becomes, how valid it is, and what is checked later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions import replies, signal
from episodica.functions.arrays import let
from episodica.sources import named_files, runs

#: The stages between six points, and what is said of them where a reply says nothing.
NAMES = ("reach", "transport", "place", "release", "grasp", "adjust", "done")
PROMPTS = {
    "reach": "Move the gripper toward the test tube.",
    "transport": "Move the grasped tube toward the mortar.",
    "place": "Pour the black powder into the mortar.",
    "release": "Release the tube and move toward the pestle.",
    "grasp": "Grasp and position the pestle.",
    "adjust": "Grind the powder with the pestle.",
    "done": "Finish the motion.",
}
EXPECTED = {
    "reach": "The gripper should approach the test tube.",
    "transport": "The tube should move toward the mortar.",
    "place": "Powder should appear in the mortar.",
    "release": "The tube should be released.",
    "grasp": "The pestle should be grasped or positioned.",
    "adjust": "The pestle should move in the mortar.",
    "done": "The robot should hold the final pose.",
}
OTHER_PROMPT, OTHER_EXPECTED = "Continue the task.", "The next task state should be visible."
REASON, SOURCE = "fixed reference boundary", "critical_ref_dir"


def default_text(table: dict[str, str], other: str, name: Column) -> Column:
    """What a table says of a stage, or the other text."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(pairs[name], F.lit(other))


def signal_summary(frames: DataFrame, names: list[str], compact: bool = False) -> DataFrame:
    """(ep, n, and a struct for each named signal): its start, min, max, end and range, and unless compact all its points
    and the steps of the signal smoothed over five frames (as it is where there are fewer), as pairs of frame and value."""
    rows = frames
    for x in names:
        few = F.count(F.lit(1)).over(signal.episode()) < 5
        rows = rows.withColumn(f"_s{x}", F.when(few, F.col(x).cast("double")).otherwise(signal.smooth_sum(F.col(x), 5) / 5.0))
    held = rows.groupBy("ep").agg(F.sort_array(F.collect_list(F.struct("f", *(y for x in names for y in (x, f"_s{x}"))))).alias("rows"))
    pairs = lambda values: F.transform(values, lambda v, i: F.struct(i.cast("long").alias("i"), F.round(v.cast("double"), 5).alias("v")))

    def of(x: str) -> Column:
        values, smoothed = F.col(f"rows.{x}"), F.col(f"rows._s{x}")
        five = lambda v: F.round(v.cast("double"), 5)
        parts = [five(values[0]).alias("start"), five(F.array_min(values)).alias("min"), five(F.array_max(values)).alias("max"), five(F.element_at(values, -1)).alias("end")]
        parts.append(five(F.array_max(values) - F.array_min(values)).alias("range"))
        if not compact:
            steps = F.zip_with(F.slice(smoothed, 2, F.greatest(F.size(smoothed) - 1, F.lit(0))), F.slice(smoothed, 1, F.greatest(F.size(smoothed) - 1, F.lit(0))), lambda b, a: b - a)
            parts += [pairs(values).alias("full_points"), pairs(steps).alias("full_velocity")]
        return F.struct(*parts).alias(x)

    return held.select("ep", F.size("rows").cast("long").alias("n"), *map(of, names))


def values_of(summary: Column) -> Column:
    """The values of a summary's full points, in order."""
    return F.transform(summary["full_points"], lambda p: p["v"])


def chosen_frames(n: Column, mode: str) -> Column:
    """The frames that a model is shown: `all`, seven evenly spaced ones (`uniform7`), or the first, middle and last; halves to even."""
    last = n - 1
    if mode == "all":
        return F.sequence(F.lit(0).cast("long"), last)
    if mode == "uniform7":
        steps = F.least(n, F.lit(7)).cast("int")
        spread = F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.when(k == 0, 0).when(k == steps - 1, last).otherwise(F.bround(k * (last / (steps - 1)), 0)).cast("long"))
        return F.array_sort(F.array_distinct(spread))
    return F.array_sort(F.array_distinct(F.array(F.lit(0).cast("long"), F.bround(last / 2, 0).cast("long"), last)))


def enforced(parsed: Column, points: Column, n: Column) -> Column:
    """A reply's JSON with the seven stages between six fixed points, each point the last frame of a stage; texts are the reply's where it has any.

    Without points, and without a reply, it stays as it is.
    """
    def stage(old: Column, k: int) -> Column:
        said = lambda field: F.nullif(F.try_variant_get(F.get(old, F.lit(k)), f"$.{field}", "string"), F.lit(""))
        start = F.lit(0).cast("long") if k == 0 else F.get(points, F.lit(k - 1)) + 1
        end = n - 1 if k == len(NAMES) - 1 else F.get(points, F.lit(k))
        return F.struct(
            F.lit(NAMES[k]).alias("name"), start.cast("long").alias("start_t"), F.greatest(start, end).cast("long").alias("end_t"),
            F.coalesce(said("prediction_prompt"), F.lit(PROMPTS.get(NAMES[k], OTHER_PROMPT))).alias("prediction_prompt"),
            F.coalesce(said("expected_future_observation"), F.lit(EXPECTED.get(NAMES[k], OTHER_EXPECTED))).alias("expected_future_observation"),
            F.coalesce(said("reason"), F.lit(REASON)).alias("reason"),
        )

    def fixed(text: Column) -> Column:
        listed = lambda old: F.array(*(stage(old, k) for k in range(len(NAMES))))
        made = let(F.try_variant_get(F.try_parse_json(text), "$.stages", "array<variant>"), listed)
        whole = F.to_json(F.struct(made.alias("stages"), points.alias("critical_points"), F.lit(SOURCE).alias("boundary_source")))
        return F.when(text.isNotNull() & (F.size(points) == len(NAMES) - 1), whole).otherwise(text)

    return let(parsed, fixed)


def validation(parsed: Column, n: Column) -> Column:
    """json_valid: does the reply have a list of stages; coverage_ok: do they follow each other from 0 to n - 1; stage_count.

    A stage of which a time is missing or no number spoils the coverage, and the next one is held against the last good end.
    """
    def times(found: Column) -> Column:
        (a, _), (b, _) = (replies.whole_number(F.try_variant_get(found, f"$.{c}", "variant")) for c in ("start_t", "end_t"))
        return F.struct(a.alias("a"), b.alias("b"))

    def follow(so_far: Column, s: Column) -> Column:
        good = (s["a"] == so_far["next"]) & (s["b"] >= s["a"]) & (s["b"] < n)
        known = s["a"].isNotNull() & s["b"].isNotNull()
        return F.struct(F.when(known, s["b"] + 1).otherwise(so_far["next"]).alias("next"), (so_far["ok"] & F.coalesce(good, F.lit(False))).alias("ok"))

    def judged(stages: Column) -> Column:
        begun = F.struct(F.lit(0).cast("long").alias("next"), (F.size(stages) > 0).alias("ok"))
        ok = F.aggregate(F.transform(stages, times), begun, follow, lambda end: end["ok"] & (end["next"] == n))
        return F.struct(stages.isNotNull().alias("json_valid"), F.coalesce(ok, F.lit(False)).alias("coverage_ok"), F.coalesce(F.size(stages), F.lit(0)).cast("long").alias("stage_count"))

    return let(F.try_variant_get(F.try_parse_json(parsed), "$.stages", "array<variant>"), judged)


def records(episodes: DataFrame, answers: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """A record for each episode (ep, n, ...): its reply's JSON, with fixed stages where references (ep, points) has six points, and its validation.

    answers are (ep, raw_response, error, latency_s); an episode without one, or with an error, has no JSON. Columns of
    episodes stay.
    """
    rows = episodes.join(answers.select("ep", "raw_response", "error", "latency_s"), "ep", "left")
    said = F.when(F.col("error").isNull(), replies.shaped(replies.json_value(F.col("raw_response"), lists=True)))
    if references is not None:
        rows = rows.join(references.select("ep", F.col("points").alias("_points")), "ep", "left")
        said = enforced(said, F.col("_points"), F.col("n"))
    both = let(said, lambda x: F.struct(x.alias("parsed_response"), validation(x, F.col("n")).alias("validation")))
    return rows.withColumn("_both", both).select(*(c for c in rows.columns if c != "_points"), "_both.*")


def counts(records_: DataFrame) -> DataFrame:
    """One row: episodes, and how many of them have valid JSON and stages without gaps."""
    return records_.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("validation.json_valid")).alias("valid_json"), F.count_if(F.col("validation.coverage_ok")).alias("full_coverage")
    )


def samples(records_: DataFrame) -> DataFrame:
    """A row for each stage of each record: its interval, what was predicted, and the frames to check, each once: first, middle, last, five later."""
    stages = F.try_variant_get(F.try_parse_json("parsed_response"), "$.stages", "array<variant>")
    each = records_.select("ep", "n", F.posexplode(stages).alias("k", "stage"))
    got = lambda c, kind="string": F.try_variant_get("stage", f"$.{c}", kind)
    start, end = got("start_t", "long"), got("end_t", "long")
    clamp = lambda x: F.greatest(F.lit(0), F.least(x, F.col("n") - 1)).cast("long")
    frames = F.array_distinct(F.array(*map(clamp, (start, F.floor((start + end) / 2), end, clamp(end + 5)))))
    prompt = F.coalesce(F.nullif(got("prediction_prompt"), F.lit("")), got("instruction"))
    return each.select(
        "ep", F.col("k").cast("long").alias("stage_index"), got("name").alias("stage_name"), F.array(start, end).alias("stage_interval"), prompt.alias("prediction_prompt"),
        got("expected_future_observation").alias("expected_future_observation"), frames.alias("check_frames"),
    )


def write_stage_run(records_: DataFrame, folder: str, model: str) -> None:
    """Puts a run's records (JSON lines), summary (CSV) and report (Markdown) in a folder; each is replaced as a whole.

    The records are computed once; summary and report are made from what was written. The report's rows are written in
    parts, in the order of episodes, so that it may be long.
    """
    spark: SparkSession = records_.sparkSession
    base, schema = folder.rstrip("/"), records_.schema
    runs.replace(records_, f"{base}/stage_annotations", backup=False)
    held = spark.read.schema(schema).json(f"{base}/stage_annotations")
    flat = held.select(
        F.col("ep").alias("episode_index"), F.col("n").alias("episode_length"), "validation.json_valid", "validation.coverage_ok", "validation.stage_count",
        "latency_s", F.coalesce("error", F.lit("")).alias("error"),
    )
    runs.replace(flat, f"{base}/summary", kind="csv", backup=False, header=True)
    c = counts(held).first()
    head = [f"# Stages of {c['episodes']} episodes", "", f"- model: `{model}`", f"- valid_json: {c['valid_json']}/{c['episodes']}", f"- full_coverage: {c['full_coverage']}/{c['episodes']}"]
    head += ["", "| episode | frames | stages | json | coverage | latency_s |", "|---:|---:|---:|---|---|---:|"]
    row = F.format_string("| %s | %s | %s | %s | %s | %s |", "episode_index", "episode_length", "stage_count", "json_valid", "coverage_ok", F.coalesce(F.col("latency_s").cast("string"), F.lit("-")))
    lines = flat.sort("episode_index").select(row.alias("value"))
    named_files.write_files(spark.createDataFrame([("head.md", "\n".join(head) + "\n")], "name string, content string"), f"{base}/report", mode="overwrite")
    lines.write.mode("append").text(f"{base}/report")
