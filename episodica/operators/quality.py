"""Scores of stages and episodes, and work that is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary(stage: Column, delta: Column, spread: Column, whole: Column) -> Column:
    """How well the gripper's signed change, or its spread, over a stage fits the stage. whole: its range over the episode."""
    r = F.greatest(whole, F.lit(1e-6))
    q = spread / r
    down, up = -delta, delta
    move = lambda d: F.when(d > 0.3 * r, 1.0).when(d > 0.1 * r, 0.7).when(F.abs(d) <= 0.1 * r, 0.4).otherwise(0.0)
    return (
        F.when(stage == "grasp", move(down))
        .when(stage == "release", move(up))
        .when(stage == "transport", F.when(q <= 0.1, 1.0).when(q <= 0.2, 0.7).when(q <= 0.4, 0.4).otherwise(0.0))
        .when(stage.isin("reach", "done"), F.when(q <= 0.1, 1.0).otherwise(0.7))
        .otherwise(0.7)
    )


def gripper(text: Column, left: Column, right: Column) -> Column:
    """The side that the text names (left first), else the one that changes more; left if equal."""
    low = F.lower(text)
    return F.when(low.contains("left"), "left").when(low.contains("right"), "right").when(F.abs(left) >= F.abs(right), "left").otherwise("right")


def rolled_up(interval: Column, edges: Column, future: Column) -> Column:
    """0.3, 0.3 and 0.4 of the three scores, to four places, halves up; computed in whole 1e-4, as sums of decimals may miss a half."""
    whole = lambda x: F.round(x * 10000).cast("long")
    return F.floor((3 * whole(interval) + 3 * whole(edges) + 4 * whole(F.coalesce(future, F.lit(0.0))) + 5) / 10) / 10000


def to_do(samples: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Samples without a scored row; rows whose score is null are tried again."""
    return samples.join(done.where(F.col("score").isNotNull()).select(*keys).distinct(), keys, "left_anti")


def last_row(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by partial aggregation rather than a sort."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(order)).alias("_row")).select("_row.*")


def log(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows of a log, one for each key: the last with a score, or the last if none has one."""
    rows = old.unionByName(new)
    whole = F.struct(*(F.col(c) for c in rows.columns))
    place = F.struct(F.col("score").isNotNull(), F.col(order))
    return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(whole, place).alias("_row")).select("_row.*")


def means(rows: DataFrame, columns: list[str], sums: list[str] = []) -> DataFrame:  # noqa: B006  never changed
    """One row: how many rows there are, the mean of each column to four places, 0 of none, and the sums of others."""
    return rows.agg(
        F.count(F.lit(1)).alias("episodes"), *(F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(f"mean_{c}") for c in columns),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums),
    )
