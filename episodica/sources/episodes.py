"""Readers and writers of episodes, annotation documents and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.sources.logs import read_lines  # noqa: F401  read with the other files of episodes

SUBTASK = "struct<subtask_id:int,label:string,start_frame:int,end_frame:int,start_t:double,end_t:double,n_frames:int,dur_s:double>"
DOCUMENT = (
    "episode_index int, task string, n_frames int, fps double, annotator string, method string, critical_points array<int>, "
    f"critical_names array<string>, subtask_starts array<int>, flags array<string>, n_subtasks int, subtasks array<{SUBTASK}>, review_points array<int>"
)


def episode_of(path: Column) -> Column:
    """The number in .../episode_NNNNNN.parquet; an error for other names."""
    number = F.regexp_extract(path, r"episode_(\d+)\.parquet$", 1)
    return F.when(number == "", F.raise_error(F.concat(F.lit("not an episode file: "), path))).otherwise(number.cast("int"))


def read_episodes(spark: SparkSession, folder: str, columns: list[str] | None = None, episodes: list[int] | None = None, first: int | None = None) -> DataFrame:
    """Frames of all episode files below folder, with episode_index from the file's name and frame from the row's place.

    Only the named columns are read, and only the files of the named episodes, of these the first ones by their path if so
    many are asked for.
    """
    names = None if episodes is None else [f"episode_{e:06d}.parquet" for e in episodes]
    glob = "episode_*.parquet" if not names else "{" + ",".join(names) + "}"
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).parquet(folder)
    if first is not None and names != []:
        kept = sorted(rows.inputFiles())[:first]
        rows = spark.read.parquet(*kept) if kept else rows.limit(0)
    if names == []:
        rows = rows.limit(0)
    wanted = [F.col(f"`{c}`") for c in columns or rows.columns if c != "episode_index"]
    return rows.select(episode_of(F.col("_metadata.file_path")).alias("episode_index"), F.col("_metadata.row_index").alias("frame"), *wanted)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One annotation document per file; missing fields are null."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def read_gripper(spark: SparkSession, path: str) -> DataFrame:
    """(frame, width) by the names of the header, in whatever order and among whatever other columns they stand."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("frame").cast("long").alias("frame"), F.col("width").cast("double").alias("width"))


def subset(text: str) -> list[int]:
    """Numbers of a list such as 3,5-7, sorted, each once; parts that are no numbers are left out."""
    out: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        a, dash, b = part.partition("-")
        if a.strip().isdigit() and (not dash or b.strip().isdigit()):
            out.update(range(int(a), int(b or a) + 1))
    return sorted(out)


def write_documents(documents: DataFrame, path: str) -> None:
    """A folder of JSON per episode."""
    documents.withColumn("part", F.col("episode_index")).write.mode("overwrite").partitionBy("part").json(path)


def append_results(results: DataFrame, path: str) -> None:
    """Adds to a log; what is done already is left out by quality.to_do before."""
    results.write.mode("append").json(path)
