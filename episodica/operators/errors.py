"""Episodes that cannot be used: reasons as flags, and errors as rows instead of failed jobs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema


def reasons(signals: list[str], least: int) -> Column:
    """Over an episode's frames (ep, f, ...): why it cannot be segmented, by windows over the episode; empty if it can."""
    whole = Window.partitionBy("ep")
    n = F.count(F.lit(1)).over(whole)
    found = [F.when(n < least, F.format_string(f"%d frames are fewer than {least}", n))]
    for s in signals:
        bad = F.count_if(F.col(s).isNull() | F.isnan(F.col(s).cast("double"))).over(whole)
        found.append(F.when(bad > 0, F.format_string(f"{s} is missing in %d frames", bad)))
    span = F.max("f").over(whole) - F.min("f").over(whole) + 1
    found.append(F.when((span != n) | (F.min("f").over(whole) != 0), F.lit("frames are not numbered from 0 without gaps")))
    return F.array_compact(F.array(*found))


def parted(frames: DataFrame, signals: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(frames of the episodes that can be used, (ep, error) of the others), in the exchange by episode that follows anyway."""
    held = frames.withColumn("_why", reasons(signals, least))
    bad = held.where(F.size("_why") > 0).groupBy("ep").agg(F.concat(F.lit("EXCEPTION: "), F.array_join(F.first("_why"), ", ")).alias("error"))
    return held.where(F.size("_why") == 0).drop("_why"), bad


def flagged(results: DataFrame, errors: DataFrame) -> DataFrame:
    """(ep, why) for review: the flags of results (ep, flags) that have any, joined, and all errors."""
    # Above an aggregate a filter stays where it is; below it, it would have the segmentation's expressions copied into each other.
    held = results.groupBy("ep").agg(F.first("flags").alias("flags"))
    some = held.where(F.size("flags") > 0).select("ep", F.array_join("flags", "; ").alias("why"))
    return some.unionByName(errors.select("ep", F.col("error").alias("why")))


def captured(rows: DataFrame, key: str, function: Callable[[pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """function of each group of rows, with `error`; a group that fails gives one row, of its key and the error alone.

    schema is that of function's result and holds the key. Use it for steps that only Python can take; a lost executor or
    a lack of memory is no error of a group and is tried again by Spark.
    """
    out = StructType([*schema.fields, StructField("error", StringType())])
    arrow = to_arrow_schema(out)

    def run(group: pa.Table) -> pa.Table:
        try:
            got = function(group).cast(pa.schema(list(arrow)[:-1]))
            return got.append_column("error", pa.nulls(got.num_rows, pa.string()))
        except Exception as failure:  # whatever a group raises is a result here
            value = group[key][0].as_py()
            row = {f.name: [value if f.name == key else None] for f in arrow} | {"error": [f"EXCEPTION: {failure}"]}
            return pa.Table.from_pydict(row, schema=arrow)

    return rows.groupBy(key).applyInArrow(run, out)
