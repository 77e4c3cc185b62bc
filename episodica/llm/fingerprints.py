"""Document fingerprints: threshold-scaled sketches of word shingles, in Spark's own functions.

A sketch keeps every shingle hash below a fixed fraction of all hashes; by default all of them, as
a sparser sketch of a short text may have no hash to compare. What two sketches share therefore is
(or, below 1, estimates) what the texts share, however unequal their lengths, and the union of two
sketches is the sketch of both texts. With a smaller fraction every sketch is cut at the same
threshold, so two are always comparable; that of a short text may then be empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.expressions import let
from episodica.llm.tables import id_texts, shards


def sketch(text: Column, width: int = 5, fraction: int = 1) -> Column:
    """Sorted distinct 63-bit hashes of runs of `width` words (of fewer words: the whole), those up to 2**63 / fraction."""
    parts = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)))
        word = lambda i: [F.get(h, i + k) for k in range(width)]  # noqa: E731  null, which the hash skips, beyond the last
        return F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*word(i)), 1))

    def keep(h: Column) -> Column:
        return F.sort_array(F.array_distinct(F.filter(h, lambda x: x <= ((1 << 63) - 1) // fraction)))

    empty = F.array().cast("array<bigint>")
    return let(hashed, lambda h: F.when(F.size(h) > 0, let(runs(h), keep)).otherwise(empty))


def merge(a: Column, b: Column, fraction: int = 1) -> Column:
    """The sketch of two texts together: all their hashes below the threshold."""
    return F.sort_array(F.filter(F.array_union(a, b), lambda x: x <= ((1 << 63) - 1) // fraction))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other one has; 1 for two empty sketches, 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def written(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by halving."""

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bounds[mid], halve(low, mid)).otherwise(halve(mid + 1, high))

    return halve(0, len(bounds))


def with_next(rows: DataFrame, columns: list[str], most_buckets: int = 2048) -> DataFrame:
    """rows (doc_id, text, ...) with next_<column>: that column of the next row by descending doc_id, cyclically.

    Rows with equal ids follow by descending text; a null id comes last. Ids are cut into buckets of like size, each
    sorted by itself; the first row of the following bucket is added at a bucket's end, so no task sorts all rows.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    rows = rows.withColumn("key", key)
    n = min(shards(rows.sparkSession), most_buckets)
    bounds = sorted({int(x) for x in rows.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("key"), bounds))
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("top")).collect())
    if not tops:
        return reduce(lambda df, c: df.withColumn(f"next_{c}", F.col(c)), columns, rows).drop("key", "bucket")
    before = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}  # the bucket that this row ends
    ends = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    firsts = rows.where(F.col("key").isin(list(before)))
    one = Window.partitionBy("key").orderBy(F.desc("text"))
    firsts = firsts.withColumn("place", F.row_number().over(one)).where("place = 1").drop("place")
    firsts = firsts.withColumn("bucket", ends[F.col("key")])
    both = rows.withColumn("after", F.lit(False)).unionByName(firsts.withColumn("after", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("after", F.desc("key"), F.desc("text"))
    found = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return found.where(~F.col("after")).drop("key", "bucket", "after")


def neighbours(docs: DataFrame) -> DataFrame:
    """For every row of docs: its sketch, that of the text whose second half is the next row's beginning, and likenesses.

    Only doc_id and text are read. A null text is empty; repeated rows stay and are each other's next rows; rows of equal
    id follow by descending text; the only row of a table is its own next one. Very long texts are read whole. Rows of one
    id, or without ids, are sorted in one task. An empty table gives an empty result.
    """
    rows = with_next(id_texts(docs), ["text"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    rows = rows.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    rows = rows.withColumns({"sketch": sketch(F.col("text")), "next_sketch": sketch(F.col("next_text")), "edited_sketch": sketch(F.col("edited"))})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
