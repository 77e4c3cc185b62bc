"""Column helpers for operators that stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AROUND = 40  # characters that a match knows of what stands before and after it


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running(numbers: Column, add: Callable[[Column, Column], Column]) -> Column:
    """add of each number and all before it, in log2(n) rounds that double the reach, each linear."""

    def reach(held: Column, by: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i >= by, add(x, F.get(held, i - by))).otherwise(x))

    def scan(held: Column) -> Column:
        rounds = F.ceil(F.log2(F.greatest(F.size(held), F.lit(1)).cast("double"))).cast("int")
        reaches = F.transform(F.sequence(F.lit(0), F.greatest(rounds, F.lit(0))), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        return F.when(F.size(held) > 1, F.aggregate(reaches, held, reach)).otherwise(held)

    return let(numbers, scan)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found,before,after>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches give their places, in time that grows with the text and n log n of its matches.
    `before` and `after` are the nearest characters, no further than the next matches. The pattern must not match the
    empty text.
    """
    size = lambda words: F.transform(words, lambda w: F.char_length(w).cast("long"))

    def placed(found: Column, pieces: Column, ends: Column) -> Column:
        def place(word: Column, i: Column) -> Column:
            end = F.get(ends, i)
            near = F.right(F.get(pieces, i), F.lit(AROUND)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AROUND)).alias("after")
            return F.struct((end - F.char_length(word)).alias("start"), end.alias("end"), word.alias("found"), *near)

        return F.transform(found, place)

    def ends(found: Column, pieces: Column) -> Column:
        return running(F.zip_with(size(F.slice(pieces, 1, F.size(found))), size(found), lambda a, b: a + b), lambda x, y: x + y)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(F.split(text, pattern, -1), lambda pieces: let(ends(found, pieces), lambda at: placed(found, pieces, at))),
    )


def apart(spans: Column, more: Column) -> Column:
    """Those of more that overlap none of spans; both are arrays of structs with start and end."""
    item = lambda at, last, start, end, i: F.struct(at.alias("at"), F.lit(last).alias("last"), start.alias("start"), end.alias("end"), i.cast("int").alias("i"))
    # A span is put at its start, one of more at its end, before spans that start there: what ends furthest of the spans before it decides.
    held = F.transform(spans, lambda s, i: item(s["start"], True, s["start"], s["end"], i))
    asked = F.transform(more, lambda m, i: item(m["end"], False, m["start"], m["end"], i))

    def clear(order: Column) -> Column:
        furthest = running(F.transform(order, lambda o: F.when(o["last"], o["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest)
        return let(
            furthest,
            lambda far: F.transform(F.filter(F.transform(order, lambda o, k: F.struct(o.alias("o"), F.get(far, k).alias("far"))), lambda z: ~z["o"]["last"] & (z["far"] <= z["o"]["start"])), lambda z: F.get(more, z["o"]["i"])),
        )

    return F.when((F.size(spans) == 0) | (F.size(more) == 0), more).otherwise(let(F.sort_array(F.concat(held, asked)), clear))
