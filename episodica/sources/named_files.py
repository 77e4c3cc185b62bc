"""A Spark data source that writes files of given names, and index files of episodes made with it."""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGED = "_staged-"


@dataclass
class Written(WriterCommitMessage):
    folder: str


class NamedFilesWriter(DataSourceArrowWriter):
    """Tasks write into a folder of their own below a staged one; the commit moves the files of the tasks that count.

    So a reader never sees half a file, a repeated or lost attempt leaves nothing, and a failed job leaves what was there.
    A folder that is not there yet is moved as a whole, so that the driver handles folders, not files, where each folder is
    one task's. Rows of one name that follow each other are one file.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staged = f"{self.path}/{STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        folder = f"{context.partitionId()}-{context.taskAttemptId()}"
        system, root = files.FileSystem.from_uri(f"{self.staged}/{folder}")
        parent = before = out = None
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    if out is None or name != before:
                        clean = posixpath.normpath(name or "")
                        if not name or clean.startswith(("/", "..")) or clean.split("/")[0].startswith(STAGED) or clean == ".":
                            raise ValueError(f"not a name below the folder: {name!r}")
                        if out is not None:
                            out.close()
                        target, before = f"{root}/{clean}", name
                        if posixpath.dirname(target) != parent:
                            system.create_dir(parent := posixpath.dirname(target), recursive=True)
                        out = system.open_output_stream(target)
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out is not None:
                out.close()
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = files.FileSystem.from_uri(self.path)
        staged = posixpath.join(root, posixpath.basename(self.staged))
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(files.FileSelector(root)):
                if not info.base_name.startswith(STAGED):
                    (system.delete_dir if info.type == files.FileType.Directory else system.delete_file)(info.path)
        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m and system.get_file_info(f"{staged}/{m.folder}").type == files.FileType.Directory:
                    self._merge(system, f"{staged}/{m.folder}", root, pool)
        self._clear(system, staged)

    @staticmethod
    def _merge(system: files.FileSystem, source: str, target: str, pool: ThreadPoolExecutor) -> None:
        """Moves what is in source into target: a folder as a whole where target has none of its name, else what is in it."""

        def moved(info: files.FileInfo) -> str | None:
            to = f"{target}/{info.base_name}"
            if info.type == files.FileType.Directory and system.get_file_info(to).type != files.FileType.NotFound:
                return info.base_name
            system.move(info.path, to)

        for name in [x for x in pool.map(moved, system.get_file_info(files.FileSelector(source))) if x]:
            system.create_dir(f"{target}/{name}", recursive=True)
            NamedFilesWriter._merge(system, f"{source}/{name}", f"{target}/{name}", pool)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = files.FileSystem.from_uri(self.path)
        self._clear(system, posixpath.join(root, posixpath.basename(self.staged)))

    @staticmethod
    def _clear(system: files.FileSystem, staged: str) -> None:
        if system.get_file_info(staged).type == files.FileType.Directory:
            system.delete_dir(staged)


class NamedFiles(DataSource):
    """Rows of (name, content) as files below the path; `overwrite` first takes away what was there."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (name, content): one file for each name, in a folder that driver and executors share.

    Names differ, or the rows of a name follow each other in one partition; then they are the file's parts, in their order.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode(mode).save(path)


def document_name(ep: str) -> Column:
    return F.format_string("ep%03d_subtasks.json", F.col(ep))


def write_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """A JSON file for each row, named after its episode_index; nulls stay, so that every document has all fields."""
    whole = F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false", "pretty": "true"})
    write_files(documents.select(document_name("episode_index").alias("name"), whole.alias("content")), path, mode)


def index_contents(intervals: DataFrame) -> DataFrame:
    """(name, content): for each episode of (ep, n, k, first, last) an array of n 16-bit numbers k in NumPy's format.

    Frames that no interval holds are 0, later intervals replace earlier ones, and those that leave the episode are cut.
    """
    part = F.struct("k", "first", "last")
    whole = intervals.groupBy("ep").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(part)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for ep, n, parts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                index = np.zeros(n, np.int16)
                for p in parts:
                    index[max(p["first"], 0) : max(p["last"] + 1, 0)] = p["k"]
                out = io.BytesIO()
                np.save(out, index)
                names.append(f"ep{ep:03d}_subtask_index.npy")
                contents.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    return whole.select("ep", F.col("n").cast("long").alias("n"), "parts").mapInArrow(run, "name string, content binary")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(ep, f, k) of all index files below path; an error names a file that is none."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", "ep*_subtask_index.npy").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    index = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                except ValueError as error:
                    raise ValueError(f"{path_} is no index file: {error}") from error
                ep = int(posixpath.basename(path_)[2:].split("_")[0])
                columns = [np.full(len(index), ep), np.arange(len(index)), index.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["ep", "f", "k"])

    return held.mapInArrow(run, "ep long, f long, k long")
