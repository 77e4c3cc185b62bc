"""Target-distribution importance resampling of documents, in Spark's own functions.

A text's features are its runs of one to `RUNS` words, hashed into `BUCKETS` buckets. Grouped counts over all documents
and over all target texts give each bucket a gain, the logarithm of how much likelier the target makes it; this table of
BUCKETS rows is broadcast and joined to the features again, and a document's gains add up to its weight. Gumbel noise from
a hash of the id turns the highest scores into a draw without replacement. Ranks come from a distributed sort: a row's
place in its partition after the rows of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.tables import cut, shards

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS, BUCKETS = 3, 10_000


def split(text: Column) -> Column:
    """The words of a text with A-Z alone in lower case; none for null."""
    lower = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def features(held: DataFrame, *keep: str, runs: int = RUNS) -> DataFrame:
    """A row for each word of the column `words` and each run that begins there; null where a run would end behind the
    text, and for a row without words."""
    placed = held.select(*keep, "words", F.posexplode_outer("words").alias("at", "word"))
    begun = [F.col("word")]
    for k in range(1, runs):
        begun.append(F.concat(begun[-1], F.lit(" "), F.get("words", F.col("at") + k)))
    return placed.select(*keep, F.explode(F.array(*begun)).alias("feature"))


def bucket(buckets: int = BUCKETS) -> Column:
    return (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket")


def counted(texts: DataFrame, name: str, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """How many features of all texts are in each bucket that has any."""
    held = texts.select(split(texts["text"]).alias("words"))
    return features(held, runs=runs).where("feature IS NOT NULL").groupBy(bucket(buckets)).agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket: a table of `buckets` rows, whatever the input."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for texts, name in ((docs, "s"), (target, "t")):
        every = every.join(counted(texts, name, runs, buckets), "bucket", "left")
    all_ = Window.partitionBy()  # over `buckets` rows
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    ratio = (t + 1) * (F.sum(s).over(all_) + buckets) / ((s + 1) * (F.sum(t).over(all_) + buckets))
    return every.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs, and row, which no two rows share."""
    held = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), split(docs["text"]).alias("words"))
    n = F.size("words").cast("long")
    held = held.select("row", "doc_id", n.alias("n_words"), "words")
    keys = ["row", "doc_id", "n_words"]
    each = features(held, *keys, runs=runs).select(*keys, bucket(buckets))
    summed = each.join(F.broadcast(gains(docs, target, runs, buckets)), "bucket", "left").groupBy(*keys).agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    number = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(runs)), F.lit(0))
    return summed.select("row", "doc_id", "n_words", number.cast("long").alias("n_features"), "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `place`, their number from 1 in the given order, which must tell all rows apart.

    The rows are sorted over all tasks; a partition's offset is the number of rows before it, added up over as many rows as
    there are partitions.
    """
    in_order = rows.repartitionByRange(shards(rows.sparkSession), *order).sortWithinPartitions(*order)
    held = cut(in_order.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return held.join(F.broadcast(offsets), "part").withColumn("place", place).drop("at", "part", "offset")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, runs: int = RUNS, buckets: int = BUCKETS, seed: int = 42
) -> DataFrame:
    """Draws percent / 100 (rounded down) of the rows of docs with at least least_words words; rank is null for the others.

    Only doc_id and text of docs and text of target are read, so other columns may have any name. Null and empty texts
    have no feature and weight 0. A very long text is an array of words in one task, and its features are rows. Equal
    scores rank by doc_id, null before all others, and equal rows, which may have the same id, in any order; each row is
    drawn or not by itself. An empty docs gives an empty result, and an empty target counts 0 in every bucket.
    """
    held = cut(scored(docs, target, runs, buckets, seed))
    may = F.col("n_words") >= least_words
    drawn = percent * held.where(may).count() // 100
    order = [may.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    rank = F.when(may & (F.col("place") <= drawn), F.col("place"))
    return ranked(held, order).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
