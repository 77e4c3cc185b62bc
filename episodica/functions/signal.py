"""Signals of episodes as window expressions. Frames are rows (ep, f, ...) with f counting from 0 in each episode."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def episode() -> WindowSpec:
    return Window.partitionBy("ep")


def ordered() -> WindowSpec:
    return episode().orderBy("f")


def around(width: int):
    """A window of an odd number of frames around each; an even width counts as the next odd one."""
    half = (width | 1) // 2
    return ordered().rowsBetween(-half, half)


def smooth_sum(x: Column, width: int) -> Column:
    """width times the centred moving mean with zeros beyond the edges; sums of integers stay exact."""
    return F.sum(x).over(around(width))


def step(x: Column) -> Column:
    """First difference; 0 for the first frame."""
    return F.coalesce(x - F.lag(x).over(ordered()), F.lit(0))


def length(*deltas: Column) -> Column:
    return F.sqrt(sum((d * d for d in deltas[1:]), deltas[0] * deltas[0]))


def share_of(x: Column, p: float) -> Column:
    """Exact percentile of the episode, with linear interpolation."""
    return F.percentile(x, F.lit(p)).over(episode())


def norm01(x: Column, low: Column, high: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low + 1e-9))), 6)


def zscore(x: Column) -> Column:
    return (x - F.avg(x).over(episode())) / (F.stddev_pop(x).over(episode()) + 1e-9)


def rest(x: Column) -> Column:
    """Median of the first max(5, n // 20) frames."""
    n = F.count(F.lit(1)).over(episode())
    head = F.greatest(F.lit(5), F.floor(n / 20))
    return F.round(F.median(F.when(F.col("f") < head, x)).over(episode()), 6)
