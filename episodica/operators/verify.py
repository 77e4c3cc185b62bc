"""Model calls as tables: requests in, replies out, decisions after. The client is a factory, so tests pass one that needs no network."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions import replies
from episodica.operators import fusion, intervals
from episodica.sources.scratch import exists

RESPONSE = "request_id string, raw_response string, error string, latency_s double"
LOGGED = RESPONSE + ", answered_at double"


def _tried(call: Callable[..., str], asked: tuple, retries: int, pause: float) -> tuple[str | None, str | None]:
    """(reply, error) of a prompt, with its images if it has any; what fails is tried again after pauses of pause, twice pause and so on, 30 seconds at most."""
    for attempt in range(1, retries + 1):
        try:
            return call(*asked), None
        except Exception as failure:  # whatever the client raises is a result here
            error = f"{type(failure).__name__}: {failure}"
            if attempt < retries:
                time.sleep(min(pause * attempt, 30.0))
    return None, error


def ask(requests: DataFrame, client: Callable[[], Callable[[str], str]], retries: int = 3, pause: float = 10.0) -> DataFrame:
    """Sends (request_id, prompt) to a client made once per task. A failure becomes the error column, never a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for frame in frames:
            out = []
            for row in frame.itertuples():
                began = time.time()
                reply, error = _tried(call, (row.prompt,), retries, pause)
                out.append((row.request_id, reply, error, time.time() - began))
            yield pd.DataFrame(out, columns=["request_id", "raw_response", "error", "latency_s"])

    return requests.select("request_id", "prompt").mapInPandas(run, RESPONSE)


def logged(spark: SparkSession, log: str) -> DataFrame:
    """The replies in a log, one for each request: the last without an error, or the last if none is without one."""
    if not exists(spark, log):
        return spark.createDataFrame([], LOGGED)
    rows = spark.read.schema(LOGGED).json(log).where("request_id IS NOT NULL")  # the end of a file may be cut off
    whole = F.struct(*(c for c in rows.columns if c != "request_id"))
    last = rows.groupBy("request_id").agg(F.max_by(whole, F.struct(F.col("error").isNull(), "answered_at")).alias("last"))
    return last.select("request_id", "last.*")


def ask_once(
    requests: DataFrame, log: str, client: Callable[[], Callable[[str], str]], at_once: int = 8, per_file: int = 1, retries: int = 3, pause: float = 10.0
) -> DataFrame:
    """The replies to all requests (request_id, prompt), asking only what the log does not answer yet.

    Tasks write replies to the log as they come, a file for each per_file of them, so that what was answered before a job
    or an executor dies is there when the job runs again. A task that is tried again reads what its earlier attempts have
    written. So no request is answered twice; the calls that a dying task has not yet written, less than per_file, and
    with per_file of 1 the one under way, are made again. Requests whose last reply is an error are asked again in the next
    run and keep all their rows in the log. At most at_once calls are made at a time, by as many tasks.

    The log is a folder that driver and executors share. Requests with the same id are asked once. Where requests have a
    column images, arrays of bytes, calls get them after the prompt.
    """
    spark, run_id = requests.sparkSession, uuid.uuid4().hex
    done = logged(spark, log).where("error IS NULL").select("request_id")
    shown = [F.min_by("images", "prompt").alias("images")] if "images" in requests.columns else []
    todo = requests.join(done, "request_id", "left_anti").groupBy("request_id").agg(F.min("prompt").alias("prompt"), *shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = files.FileSystem.from_uri(log)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        mine = f"run-{run_id}-{context.partitionId()}-"
        answered = set()
        for info in system.get_file_info(files.FileSelector(root)):
            if info.base_name.startswith(mine):
                with system.open_input_stream(info.path) as held:
                    answered |= {json.loads(line)["request_id"] for line in held.read().decode().splitlines()}
        call, waiting, written = client(), [], 0

        def flush() -> None:
            """A reader sees the file whole or not at all: names that begin with an underscore are passed over."""
            nonlocal written
            name = f"{mine}{context.taskAttemptId()}-{written}.json"
            with system.open_output_stream(f"{root}/_{name}") as out:
                out.write("".join(json.dumps(row, ensure_ascii=False) + "\n" for row in waiting).encode())
            system.move(f"{root}/_{name}", f"{root}/{name}")
            written += 1
            waiting.clear()

        count = 0
        for batch in batches:
            for request_id, *asked in zip(*(column.to_pylist() for column in batch.columns)):
                if request_id in answered:
                    continue
                began = time.time()
                reply, error = _tried(call, tuple(asked), retries, pause)
                now = time.time()
                waiting.append({"request_id": request_id, "raw_response": reply, "error": error, "latency_s": now - began, "answered_at": now})
                count += 1
                if len(waiting) >= per_file:
                    flush()
        if waiting:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["asked"])

    todo.repartition(at_once, "request_id").mapInArrow(run, "asked long").agg(F.sum("asked")).collect()
    return requests.select("request_id").distinct().join(logged(spark, log), "request_id")


def windows(points: DataFrame, reach: int) -> DataFrame:
    """(ep, i, c, n, lo, hi): the frames within reach of each point and between its neighbours; a few around it where these leave none."""
    c, n, few = F.col("c"), F.col("n"), max(2, reach // 2)
    near = intervals.by_point()
    lo = F.greatest(F.lit(0), c - reach, F.coalesce(F.lag("c").over(near) + 1, F.lit(0)))
    hi = F.least(n - 1, c + reach, F.coalesce(F.lead("c").over(near) - 1, n - 1))
    held = points.select("ep", "i", "c", "n", lo.alias("lo"), hi.alias("hi"))
    none = F.col("hi") <= F.col("lo")
    return held.select(
        "ep", "i", "c", "n", F.when(none, F.greatest(F.lit(0), c - few)).otherwise(F.col("lo")).alias("lo"), F.when(none, F.least(n - 1, c + few)).otherwise(F.col("hi")).alias("hi")
    )


def point_requests(points: DataFrame, names: list[str], fps: float, task: Column | str, reach_s: float = 2.0, candidates: int = 7, show_state: bool = False) -> DataFrame:
    """(request_id, ep, i, c, n, lo, hi, frames, prompt): a question for each point of (ep, i, c, n), which of some frames it is.

    The frames are spaced evenly over the point's window, and the point's own. The id is made of episode and point, so the
    same point has the same id in every run. With show_state the question says what the signals say.
    """
    held = windows(points, int(reach_s * fps))
    spaced = F.array_sort(F.array_union(fusion.spaced(F.col("lo"), F.col("hi"), candidates), F.array("c")))
    held = held.withColumn("frames", F.transform(spaced, lambda x: F.greatest("lo", F.least("hi", x))))
    name = F.array(*map(F.lit, names))[(F.col("i") - 1).cast("int")]
    said = F.format_string("The signals say frame %d.", "c") if show_state else F.lit("Judge by the images alone.")
    prompt = F.format_string(
        'Task: %s\nEpisode %d, point %d (%s). %s\nChoose one of the frames %s. Answer with JSON: {"selected_frame": number, "confidence": "high|medium|low", "visual_evidence": text}',
        F.lit(task) if isinstance(task, str) else task, "ep", "i", name, said, F.array_join("frames", ", "),
    )
    return held.select(F.format_string("%06d-%d", "ep", "i").alias("request_id"), "ep", "i", "c", "n", "lo", "hi", "frames", prompt.alias("prompt"))


def with_images(requests: DataFrame, files_: DataFrame, cameras: list[str], form: str = "keyframes/episode_%06d_%s_t%04d.jpg") -> DataFrame:
    """requests with images, the names of those files (name) that show their frames: all of one camera, then of the next."""
    seen_by = lambda camera: F.transform("frames", lambda f: F.format_string(form, F.col("ep"), F.lit(camera), f))
    wanted = F.flatten(F.array(*map(seen_by, cameras)))
    each = requests.select("request_id", F.posexplode(wanted).alias("place", "name"))
    there = each.join(files_.select("name").distinct(), "name", "left_semi").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("held"))
    none = F.array().cast("array<string>")
    return requests.join(there, "request_id", "left").withColumn("images", F.coalesce(F.col("held.name"), none)).drop("held")


def decided(requests: DataFrame, answers: DataFrame, fps: float, most_s: float = 0.67, least: int = 2) -> DataFrame:
    """requests with what their answers say: selected frame, delta, confidence, evidence, decision, and to, where the point goes.

    The selected frame is the nearest of the request's frames. A request without an answer, or with an error, stays where
    it is, `no_reply`. Of the others only those that are `accepted` move.
    """
    joined = requests.join(answers.select("request_id", "raw_response", "error"), "request_id", "left")
    found = replies.json_in(F.col("raw_response"))
    got = lambda name: F.try_variant_get(F.try_parse_json(found), f"$.{name}", "string")
    has = F.col("raw_response").isNotNull() & F.col("error").isNull()
    selected = F.when(has, fusion.nearest_of(F.col("frames"), replies.selected(found, F.col("c")))).otherwise(F.col("c"))
    rows = joined.withColumns({"selected": selected, "confidence": F.when(has, fusion.confidence(got("confidence"))), "evidence": F.when(has, F.trim(F.coalesce(got("visual_evidence"), F.lit(""))))})
    rows = rows.withColumn("delta", F.col("selected") - F.col("c"))
    why = F.when(~has, "no_reply").otherwise(fusion.decision(F.col("confidence"), F.col("delta"), F.col("evidence"), F.col("i"), int(most_s * fps), least))
    rows = rows.withColumn("decision", why)
    return rows.withColumn("to", F.when(F.col("decision") == "accepted", F.col("selected")).otherwise(F.col("c"))).drop("raw_response", "error")


def proposal(decisions: DataFrame, points: int = 6) -> DataFrame:
    """(ep, i, c, n, state): the points after their decisions, put in order again; state is where they were."""
    rows = decisions.select("ep", "i", F.col("to").alias("c"), "n", F.col("c").alias("state"))
    return rows.select("ep", "i", intervals.repair(points).alias("c"), "n", "state")


def report(decisions: DataFrame, points: int = 6) -> DataFrame:
    """A row per episode: points that moved, points that are certain, the largest change, points before and after, decisions."""
    after = proposal(decisions, points).select("ep", "i", F.col("c").alias("after"))
    rows = decisions.join(after, ["ep", "i"])
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda x: x[c].cast("string"))
    return rows.groupBy(F.col("ep").alias("episode_index")).agg(
        F.count_if(F.col("after") != F.col("c")).alias("moved_points"),
        F.count_if(F.col("confidence") == "high").alias("high_conf_points"),
        F.max(F.abs("delta")).alias("max_abs_delta"),
        F.array_join(in_order("c"), " ").alias("state_cps"),
        F.array_join(in_order("after"), " ").alias("proposal_cps"),
        F.array_join(in_order("decision"), ";").alias("decisions"),
    )
