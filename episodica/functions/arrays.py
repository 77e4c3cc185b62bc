"""Whole signals of an episode as arrays, so that steps that depend on each other need no further shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "struct<s:bigint,e:bigint,best_s:bigint,best_e:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def percentile(values: Column, p: float) -> Column:
    """Exact percentile of an array, with linear interpolation; null for an empty one."""

    def of(held: Column) -> Column:
        at = (F.size(held) - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        a, b = F.get(held, low), F.get(held, F.least(low + 1, F.size(held) - 1))
        return a + (b - a) * (at - low)

    return let(F.sort_array(F.transform(values, lambda x: x.cast("double"))), of)


def norm01(values: Column) -> Column:
    """Between the first and the 99th percentile, to six places."""
    one = lambda x, low, high: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low + 1e-9))), 6)
    low, high = F.round(percentile(values, 0.01), 6), F.round(percentile(values, 0.99), 6)
    return let(F.struct(low.alias("low"), high.alias("high")), lambda b: F.transform(values, lambda x: one(x, b["low"], b["high"])))


def rest(values: Column) -> Column:
    """Median of the first max(5, n // 20)."""
    head = F.greatest(F.lit(5), F.floor(F.size(values) / 20)).cast("int")
    return F.round(percentile(F.slice(values, 1, head), 0.5), 6)


def hold(mask: Column, gap: int) -> Column:
    """struct(s, e): the longest true run, half-open, of a mask whose false runs shorter than gap between true ones are closed.

    The earliest of equal runs; (0, 0) where nothing is true.
    """
    none = F.lit(-1).cast("bigint")
    start = F.struct(none.alias("s"), none.alias("e"), F.lit(0).cast("bigint").alias("best_s"), F.lit(0).cast("bigint").alias("best_e"))
    at = F.filter(F.transform(mask, lambda on, i: F.when(on, i.cast("bigint"))), lambda i: i.isNotNull())

    def add(held: Column, i: Column) -> Column:
        s = F.when((held["e"] >= 0) & ((i == held["e"]) | (i - held["e"] < gap)), held["s"]).otherwise(i)
        longer = i + 1 - s > held["best_e"] - held["best_s"]
        best_s, best_e = F.when(longer, s).otherwise(held["best_s"]), F.when(longer, i + 1).otherwise(held["best_e"])
        return F.struct(s.alias("s"), (i + 1).alias("e"), best_s.alias("best_s"), best_e.alias("best_e"))

    return F.aggregate(at, start, add, lambda held: F.struct(held["best_s"].alias("s"), held["best_e"].alias("e")))


def share(n: Column, p: float) -> Column:
    """The whole part of p * n."""
    return (F.lit(p) * n).cast("long")
