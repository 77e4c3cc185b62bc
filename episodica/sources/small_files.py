"""Folders of very many small files: tasks list and read them, so the driver holds neither their names nor their contents."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed value: folders of one task, at most, where there are more tasks than Spark would make anyway.
FOLDERS = 16


def read(spark: SparkSession, root: str, rows_of: Callable[[str, Callable[[], pa.NativeFile]], Iterator[tuple]], schema: str, batch: int = 20_000) -> DataFrame:
    """The rows that rows_of(name, open) gives of each file below root; a name is the path from root on.

    The driver lists only what stands next to root. The folders there are dealt to tasks, which list what is in them and read
    it; so files should be dealt to many folders. Rows of a file come in their order, `batch` at a time.
    """
    base, top = files.FileSystem.from_uri(root)
    names = [(x.base_name,) for x in base.get_file_info(files.FileSelector(top)) if not x.base_name.startswith(("_", "."))]
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, min(len(names), max(least, len(names) // FOLDERS)))
    # Of rows from an RDD Spark guesses no size; by that of a list of folders it would broadcast what is in them.
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(names, parts), "name string")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = files.FileSystem.from_uri(root)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        rows = []
        for name in (name for held in batches for name in held.column(0).to_pylist()):
            info = system.get_file_info(f"{top}/{name}")
            found = [info] if info.is_file else system.get_file_info(files.FileSelector(info.path, recursive=True))
            for file in found:
                if file.is_file and not file.base_name.startswith(("_", ".")):
                    for row in rows_of(file.path[len(top.rstrip("/")) + 1 :], lambda: system.open_input_stream(file.path)):
                        rows.append(row)
                        if len(rows) == batch:
                            yield made(rows)
                            rows = []
        if rows:
            yield made(rows)

    return dealt.mapInArrow(run, schema)


def _lines(stream: pa.NativeFile) -> Iterator[str]:
    """Lines as Spark's readers cut them, without their ends."""
    with io.TextIOWrapper(stream, encoding="utf-8", errors="replace") as text:
        for line in text:
            yield line.removesuffix("\n")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(name, content) of all files below root."""

    def rows_of(name: str, opened: Callable) -> Iterator[tuple]:
        with opened() as stream:
            yield name, stream.read()

    return read(spark, root, rows_of, "name string, content binary", batch=500)


def lines(spark: SparkSession, root: str) -> DataFrame:
    """(name, line, value) of all lines of all files below root; lines count from 1."""

    def rows_of(name: str, opened: Callable) -> Iterator[tuple]:
        for k, line in enumerate(_lines(opened()), 1):
            yield name, k, line

    return read(spark, root, rows_of, "name string, line long, value string")


def columns(spark: SparkSession, root: str, wanted: dict[str, str]) -> DataFrame:
    """(folder, file, place, value): of CSV files without keys a column each, by its name in the header, with its rows' places.

    wanted names a column for each file's name; other files are not opened. Missing values are null. A file without such a
    column is an error.
    """

    def fields(line: str) -> list[str]:
        return next(csv.reader([line])) if '"' in line else line.split(",")

    def rows_of(name: str, opened: Callable) -> Iterator[tuple]:
        folder, _, file = name.rpartition("/")
        if (column := wanted.get(file)) is None:
            return
        held = (fields(line) for line in _lines(opened()) if line.strip())
        if (head := next(held, None)) is None:
            return
        if column not in head:
            raise ValueError(f"{name} has no column {column}")
        at = head.index(column)
        for place, row in enumerate(held):
            yield folder, file, place, (row[at] if at < len(row) else None) or None

    return read(spark, root, rows_of, "folder string, file string, place long, value string")
