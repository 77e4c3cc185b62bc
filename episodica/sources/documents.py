"""Annotation documents, task texts and manifests by episode, from folders of JSON and parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators.fusion import complete
from episodica.sources.episodes import DOCUMENT
from episodica.sources.scratch import exists

#: The name of documents' files, and the task where no file says one.
NAME = r"/ep(\d+)_subtasks\.json$"
TASK = "Pour the black powder into the mortar and grind."


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of files named after their episode, with `file` and `named`, the number in the name."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).option("pathGlobFilter", "ep*_subtasks.json").json(folder)
    held = rows.select("*", F.col("_metadata.file_path").alias("file"))
    return held.withColumn("named", F.regexp_extract("file", NAME, 1).try_cast("int"))


def annotation_map(spark: SparkSession, folder: str) -> DataFrame:
    """(ep, document) of all documents in a folder, by their episode_index, or where they have none by their name.

    Of several documents for an episode the one whose path sorts last counts. A name without a number is an error even of
    a document that says its episode, and so is a folder without documents.
    """
    rows = _documents(spark, folder)
    if not rows.inputFiles():
        raise FileNotFoundError(f"no ep*_subtasks.json files in {folder}")
    error = F.raise_error(F.concat(F.lit("no episode in the name of "), "file")).cast("int")
    ep = F.when(F.col("named").isNull(), error).otherwise(F.coalesce("episode_index", "named"))
    whole = F.struct(*(c for c in rows.columns if c not in ("file", "named")))
    held = rows.select(ep.alias("ep"), "file", whole.alias("document"))
    return held.groupBy("ep").agg(F.max_by("document", "file").alias("document"))


def documents_of(spark: SparkSession, folder: str, episodes: DataFrame) -> DataFrame:
    """episodes (ep) with the document whose file is named after each, null where there is none."""
    rows = _documents(spark, folder)
    whole = F.struct(*(c for c in rows.columns if c not in ("file", "named")))
    return episodes.join(rows.select(F.col("named").alias("ep"), whole.alias("document")), "ep", "left")


def points_of(document: Column) -> tuple[Column, Column]:
    """(points, review): a document's points if there are exactly six, else null, and the points that are for review, maybe none."""
    return complete(document["critical_points"]), F.coalesce(document["review_points"], F.array().cast("array<int>"))


def episodes_in(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(ep) of the documents in a folder by their names, or the wanted ones, there or not."""
    if wanted is not None:
        return spark.createDataFrame([(e,) for e in sorted(set(wanted))], "ep int")
    return _documents(spark, folder).select(F.col("named").alias("ep")).where("ep IS NOT NULL").distinct()


def task_of(spark: SparkSession, path: str, default: str = TASK) -> str:
    """The task in the first line of JSON lines; the default where the file, the line or the task is missing."""
    if not exists(spark, path):
        return default
    first = spark.read.text(path).select(F.try_variant_get(F.try_parse_json("value"), "$.task", "string")).first()
    return first[0] if first and first[0] is not None else default


def task_table(spark: SparkSession, path: str) -> DataFrame:
    """(task_index, task) of a table whose text is its index, as it is written from a data frame that is indexed by text."""
    rows = spark.read.parquet(path)
    text = "task" if "task" in rows.columns else "__index_level_0__"
    return rows.select(F.col("task_index").cast("long").alias("task_index"), F.col(text).alias("task"))


def with_tasks(rows: DataFrame, tasks: DataFrame, said: str | None = None) -> DataFrame:
    """rows (task_index, ...) with task: what is said, else the table's text, else a name made of the index.

    A task is few words and a table of tasks has as many rows as there are tasks, so Spark broadcasts it where it is small.
    """
    if said and said.strip():
        return rows.withColumn("task", F.lit(said.strip()))
    named = F.coalesce("task", F.concat(F.lit("task_index_"), F.col("task_index").cast("string")))
    return rows.join(tasks.select("task_index", "task").dropDuplicates(["task_index"]), "task_index", "left").withColumn("task", named)


def manifests(spark: SparkSession, root: str, schema: str = "session_start_unix_us long, session_start_ticks_us long") -> DataFrame:
    """(demo, unix_us, ticks_us) of the manifest of each recording below root; null times where it is no JSON."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root)
    demo = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/ego_data/[^/]+/manifest\.json$", 1)
    held = rows.select(demo.alias("demo"), F.col("session_start_unix_us").alias("unix_us"), F.col("session_start_ticks_us").alias("ticks_us"), F.col("_metadata.file_path").alias("file"))
    one = F.min_by(F.struct("unix_us", "ticks_us"), "file").alias("m")
    return held.where("demo <> ''").groupBy("demo").agg(one).select("demo", "m.*")
