"""Writers of whole runs: tables that are replaced in one step, and summaries that only full runs may change."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from episodica.sources.scratch import beside, delete, exists, file_system, move

BACKUP = ".bak"


def replace(rows: DataFrame, path: str, kind: str = "json", backup: bool = True, **options: object) -> None:
    """Writes rows aside and then puts them in place of what path held, which stays beside it as a backup.

    rows may be read from path itself. A write that fails leaves path as it was. Readers find the old rows or the new ones,
    whole, as a folder is renamed; if the second rename fails the first is taken back. An older backup goes only when the
    new rows are written; without backup the old rows go.
    """
    spark, aside, old = rows.sparkSession, beside(path, f".new-{uuid.uuid4().hex}"), beside(path, BACKUP)
    options = {"ignoreNullFields": False, **options} if kind == "json" else options
    try:
        rows.write.options(**options).format(kind).save(aside)
    except Exception:
        delete(spark, aside)
        raise
    if exists(spark, path):
        delete(spark, old)
        move(spark, path, old)
        try:
            move(spark, aside, path)
        except Exception:
            move(spark, old, path)
            raise
        if not backup:
            delete(spark, old)
    else:
        move(spark, aside, path)


def write_run(documents: DataFrame, folder: str, expected: int, summary: Callable[[DataFrame], DataFrame]) -> bool:
    """Writes the documents (episode_index, ...) of a run; all of them and their summary only if the run was a full one.

    The documents are counted while they are written, by episode. If as many as expected were written, and no episode
    twice, then `all_subtasks` is replaced by them and `summary` by what summary makes of them; both are made from what was
    written, so nothing is computed again. Otherwise both stay as they were. Returns whether they were replaced.
    """
    spark, seen = documents.sparkSession, Observation()
    target = f"{folder.rstrip('/')}/documents"
    counted = documents.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("episode_index").isNull()).alias("unnamed"))
    run = f"{target}/run={uuid.uuid4().hex}"
    counted.write.json(run, ignoreNullFields=False)
    if seen.get["rows"] != expected or seen.get["unnamed"]:
        return False
    written = spark.read.schema(documents.schema).json(run)
    if written.select("episode_index").distinct().count() != expected:
        return False
    replace(written, f"{folder.rstrip('/')}/all_subtasks", backup=False)
    replace(summary(written).coalesce(1), f"{folder.rstrip('/')}/summary", kind="csv", backup=False, header=True)
    return True


def latest_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The documents of all runs, partial ones too."""
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/documents")


def latest(spark: SparkSession, root: str, with_file: str = "") -> str | None:
    """The folder below root that was changed last, of those that hold with_file; None if there is none."""
    fs, made = file_system(spark, root)
    if not fs.exists(made(root)):
        return None
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(made(root)) if s.isDirectory()]
    held = [f for f in found if not with_file or fs.exists(made(f"{f[1]}/{with_file}"))]
    return max(held)[1] if held else None
