"""Places of rows in files that are read in many splits: numbers of lines, and joins by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: So many splits of files, a few numbers and a path each, are broadcast; of more, Spark chooses.
MOST_SPLITS = 200_000


def placed(rows: DataFrame) -> DataFrame:
    """rows, as a reader of files gives them, with `file` and `place`, their number in the file from 0.

    A first pass counts the rows of each split; a row's place is its place in the split after all splits before it. The
    counts are a row for each split, so they are broadcast unless there are very many.
    """
    held = rows.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at")
    )
    splits = held.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if len(rows.inputFiles()) + rows.rdd.getNumPartitions() <= MOST_SPLITS:  # a split begins a file or a partition
        splits = F.broadcast(splits)
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return held.join(splits, ["file", "_split"]).withColumn("place", place).drop("_split", "_at", "_first", "_before")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of all lines of text files, blank ones too; lines count from 1."""
    rows = placed(spark.read.text(path))
    return rows.select("file", (F.col("place") + 1).alias("line"), "value")


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both that have the same keys and place, as a zip of both pairs them: the longer side is cut."""
    return left.join(right, [*keys, "place"])
