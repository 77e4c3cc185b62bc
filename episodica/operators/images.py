"""Images of frames: cells of camera columns, read for the wanted frames alone, as bytes, files and data URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType


def content(rows: DataFrame, camera: str) -> tuple[Column, Column]:
    """(bytes, path) of a camera's cells, which are bytes, or structs of bytes and a path; other types are an error."""
    kind = rows.schema[camera].dataType
    cell, no_bytes, no_path = F.col(f"`{camera}`"), F.lit(None).cast("binary"), F.lit(None).cast("string")
    if isinstance(kind, BinaryType):
        return cell, no_path
    if isinstance(kind, StructType) and {"bytes", "path"} & set(kind.names):
        path = cell["path"] if "path" in kind.names else no_path
        return (cell["bytes"] if "bytes" in kind.names else no_bytes), F.nullif(path, F.lit(""))
    if isinstance(kind, StringType):
        return no_bytes, cell
    raise TypeError(f"{camera} holds {kind.simpleString()}, not images")


def cells(rows: DataFrame, wanted: DataFrame, cameras: list[str], files: DataFrame | None = None) -> DataFrame:
    """(ep, f, camera, content) of the wanted frames (ep, f) of rows (ep, f, a column for each camera), where there is an image.

    Frames are chosen before any image is read. A cell without bytes but with a path is looked up in files (path, content),
    as Spark's reader of binary files gives them; without files, or without such a file, there is no image.
    """
    kept = rows.join(wanted.select("ep", "f").distinct(), ["ep", "f"], "left_semi")
    one = lambda camera: F.struct(F.lit(camera.rsplit(".", 1)[-1]).alias("camera"), *(x.alias(n) for x, n in zip(content(rows, camera), ("content", "path"))))
    each = kept.select("ep", "f", F.inline(F.array(*map(one, cameras))))
    if files is not None:
        bare = lambda p: F.regexp_replace(p, r"^file:/*", "/")
        held = files.select(bare(F.col("path")).alias("_path"), F.col("content").alias("_content"))
        needed = F.when(F.col("content").isNull(), bare(F.col("path")))
        each = each.join(held, needed == F.col("_path"), "left").withColumn("content", F.coalesce("content", "_content"))
    return each.where("content IS NOT NULL").select("ep", "f", "camera", "content")


def named(cells_: DataFrame, folder: Column | None = None) -> DataFrame:
    """(name, content) of a file for each cell; folder, which ends with a slash, comes before the file's own name."""
    own = F.format_string("episode_%06d_%s_t%04d.jpg", "ep", "camera", "f")
    return cells_.select((own if folder is None else F.concat(folder, own)).alias("name"), "content")
