"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of the session's context; the warehouse where neither is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """rows, computed once and read from the shared folder from then on."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared(rows.sparkSession))
    return rows.checkpoint()


def beside(path: str, ending: str) -> str:
    return f"{path.rstrip('/')}{ending}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of the path, what makes paths of it)."""
    made = spark._jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    fs, made = file_system(spark, path)
    return fs.exists(made(path))


def delete(spark: SparkSession, path: str) -> None:
    fs, made = file_system(spark, path)
    fs.delete(made(path), True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, made = file_system(spark, source)
    if not fs.rename(made(source), made(target)):
        raise OSError(f"{source} could not become {target}")
