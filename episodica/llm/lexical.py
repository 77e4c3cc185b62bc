"""Ranked lexical search: a blocked product of an item-term and a term-document matrix of integers.

The terms of a block of items are its columns. One pass over the documents counts the documents that hold each of these
terms; a second pass makes every block of documents a matrix with a row for each term, of 64-bit impacts, and multiplies:
for each item, the rows of its terms are added up into one sum for each document (Gustavson's order). Of the sums of a
block only those that reach an item's best `k` so far are kept; what the tasks keep is reduced to `k` rows of each item
in two steps, so that no task reads the rows of all tasks. Terms are compared as strings, and all sums are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm import words
from episodica.llm.tables import cut

UNIT, FREE, LIKE_LENGTH = 1_000_000_000, 10, 90  # of impacts; of a document's length 10 % count as they are, 90 % by its ratio to the mean
FOUND = "item long, doc_id long, score long"


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one after the other, and how many each text has; A-Z alone in lower case, null is empty."""
    data, offsets = words.text_buffer(column)
    data = words.ASCII_LOWER[data]
    starts, ends, first = words.spans(data, offsets, words.ALNUM)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    held = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[words.ALNUM[data]])))
    return held, np.diff(first)


class Items:
    """A block of items: for each item the columns of its different terms and how often it has them."""

    def __init__(self, texts: pa.Array):
        held, size = terms(texts)
        coded = held.dictionary_encode()
        self.terms, column = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        item = np.repeat(np.arange(len(size)), size)
        keys, self.times = np.unique(item * max(1, len(self.terms)) + column, return_counts=True)
        self.column = keys % max(1, len(self.terms))
        self.first = np.searchsorted(keys // max(1, len(self.terms)), np.arange(len(size) + 1))

    def columns(self, held: pa.Array) -> np.ndarray:
        """The column of each term, -1 if no item has it."""
        return pc.fill_null(pc.index_in(held, value_set=self.terms), -1).to_numpy().astype(np.int64)


def counts(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and how many documents hold each column's term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, all_, df = 0, 0, np.zeros(len(items.terms), np.int64)
        for part in words.bounded(batches, 1):
            held, size = terms(part.column(1))
            column = items.columns(held)
            known = column >= 0
            doc = np.repeat(np.arange(len(size)), size)[known]
            pairs = np.unique(doc * len(df) + column[known]) if len(df) else np.zeros(0, np.int64)
            n, all_ = n + int((size > 0).sum()), all_ + int(size.sum())
            df += np.bincount(pairs % max(1, len(df)), minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([n, all_, *df[at].tolist()], pa.int64())], ["column", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()  # one for each column at most
    found = {r["column"]: r["n"] for r in rows}
    df = np.zeros(len(items.terms), np.int64)
    for column, n in found.items():
        if column >= 0:
            df[column] = n
    return found.get(-1, 0), found.get(-2, 0), df


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, all_terms: int) -> np.ndarray:
    """How much tf occurrences count in documents of n terms, in integers; where 64 bits are too few, by Python's."""
    if len(n) and LIKE_LENGTH * int(n.max()) * docs >= 1 << 63:
        ratio = np.array([LIKE_LENGTH * int(x) * docs // all_terms for x in n], np.int64)
    else:
        ratio = LIKE_LENGTH * n * docs // max(1, all_terms)
    m = FREE + ratio
    return UNIT * tf // (1000 * tf + 8 * m)


class Best:
    """The k highest documents of an item so far: by score, then by id, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        if len(score) > self.k:
            high = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc, null = score[high], doc[high], null[high]
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def _search(items: Items, weight: np.ndarray, docs: int, all_terms: int, k: int, multiplicity: bool):
    times = items.times if multiplicity else np.ones_like(items.times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in range(len(items.first) - 1)]
        width = max(1, len(items.terms))
        for part in words.bounded(batches, 1):
            held, size = terms(part.column(1))
            column = items.columns(held)
            known = column >= 0
            doc = np.repeat(np.arange(len(size)), size)[known]
            # The block as a matrix by terms: for each column the documents that hold its term, and their impacts.
            pairs, tf = np.unique(column[known] * len(size) + doc, return_counts=True)
            row, column = pairs % max(1, len(size)), pairs // max(1, len(size))
            value = weight[column] * impacts(tf, size[row].astype(np.int64), docs, all_terms)
            first = np.searchsorted(column, np.arange(width + 1))
            ids = part.column(0)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
            for i, kept in enumerate(best):
                total = np.zeros(len(size), np.int64)
                for c, n in zip(items.column[items.first[i] : items.first[i + 1]].tolist(), times[items.first[i] : items.first[i + 1]].tolist()):
                    a, b = first[c], first[c + 1]
                    total[row[a:b]] += n * value[a:b]  # a document is in a row once
                if len(high := np.flatnonzero(total >= kept.least)):
                    kept.add(total[high], ids[high], null[high])
        for i, kept in enumerate(best):
            if len(kept.score):
                columns = [pa.array(np.full(len(kept.score), i)), pa.array(kept.doc, mask=kept.null), pa.array(kept.score)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def highest(rows: DataFrame, k: int, shares: int = 64) -> DataFrame:
    """The k highest rows of each item with their rank; an item's rows are reduced in `shares` tasks, then in one."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = F.pmod(F.xxhash64("doc_id", "score", F.monotonically_increasing_id()), F.lit(shares))
    some = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order)))
    some = some.where(F.col("rank") <= k).drop("rank", "share")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, multiplicity: bool = False, block_items: int = 20_000, block_bytes: int = 1 << 24) -> DataFrame:
    """item_id, rank, doc_id, score of the k highest rows of docs, with a score above 0, for each row of items.

    A term's weight is 1000 ln((2 N + 2) / (2 df + 1)), rounded down; an item's terms count once each, or as often as it
    has them with `multiplicity`. Items are taken in blocks of about block_items rows and block_bytes of text, which tasks
    hold; a larger table takes as many passes, with the same result.

    Only doc_id and text of docs, item_id and text of items are read. Null and empty texts have no terms: such items have
    no rows, such documents are never found. Very long texts are matched whole, in one task. Equal scores rank by doc_id,
    null last; equal rows of docs, or rows with the same id, are found and ranked by themselves, and so are equal rows of
    items, whose results then repeat. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(items["text"])), F.lit(0)).alias("bytes")).first()
    number = max(1, -(-size["rows"] // block_items), -(-size["bytes"] // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(number)).cast("int")
    held = cut(items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text")).withColumn("block", block))
    blocks = [r["block"] for r in held.select("block").distinct().orderBy("block").collect()]
    out = []
    for number in blocks:
        table = held.where(F.col("block") == number).select("item_id", "text").toArrow()  # a block's rows
        one = Items(table["text"].combine_chunks())
        n, all_terms, df = counts(docs, one)
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = highest(docs.mapInArrow(_search(one, weight, n, all_terms, k, multiplicity), FOUND), k)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(table.num_rows)), "item_id": table["item_id"]}))
        found = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out.append(found if len(blocks) == 1 else cut(found))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
