"""Reading the input tables and cutting lineage through the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, or the one that the session's context has set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run herein drop their shuffle files when they end, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def id_remainder(doc_id, modulus: int):
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    written = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(written, F.lit("")).cast("binary")) % modulus


def id_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, null text as empty; other columns, whatever their names, are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def shards(spark: SparkSession) -> int:
    """How many parts shuffled work has: the session's own setting, which grows with the cluster and its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(left: DataFrame, right: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """left with the columns of right, whose keys are unique, by an inner join in which no key fills a task.

    The thousand most frequent keys of more than `least` rows are hot: their rows of right are broadcast, so rows of left
    with such a key stay where they are. All other keys, none of which has a thousandth of left's rows, are shuffled.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("rows in all")).where(F.col("rows in all") > least)
    hot = [r[0] for r in counts.orderBy(F.desc("rows in all")).limit(1000).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key).unionByName(left.where(~is_hot).join(right.where(~is_hot), key))


def small(df: DataFrame, most: int = 1_000_000) -> bool:
    """Has df few enough rows (of a few numbers each) to be broadcast? Counts no further than it must."""
    return df.limit(most + 1).count() <= most


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What fit makes of a bounded sample, in one task: the driver gets the model alone. None for an empty sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())], ["model"])

    row = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return cloudpickle.loads(row[0]) if row else None
