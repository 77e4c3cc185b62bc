"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every passage with block-max WAND.

Weights are divided by what an item scores against itself, so a score is the share of an item's
weight that a passage covers, and one threshold serves long and short items. Numbers of items,
document frequencies and the mean length are those of the whole benchmark. Items go by length into
classes, each with an index of its own; its passages are windows of twice the length of its longest
item at steps of that length, so whatever repeats an item lies whole in one of them. Block-max WAND
runs over whole lists; the blocks are ranges of items, and what a passage can reach in each block
is added up for all passages of a batch by array arithmetic. Passages that reach the threshold in
no block are done; for all others WAND walks the lists, skipping the blocks that cannot reach it.
What WAND returns is verified: the question must be there in word shingles and the answer in words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm import words

FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
K1, B = 1.2, 0.75


def split_words(text: str) -> list[bytes]:
    data = text.lower().encode()
    at = np.array([0, len(data)], dtype=np.int64)
    starts, ends, _ = words.spans(np.frombuffer(data, np.uint8), at, words.ALNUM)
    return [data[a:b] for a, b in zip(starts, ends)]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; of a single sentence, the last third of its words."""
    parts = [p for p in (split_words(p) for p in re.split(r"(?<=[.?!])\s+|\n", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    all_words = parts[0] if parts else []
    cut = len(all_words) - len(all_words) // 3
    return all_words[:cut], all_words[cut:]


def shingles(text: list, width: int = 5) -> set:
    """Runs of `width` words; of a shorter text, the whole."""
    return {tuple(text[i : i + width]) for i in range(max(1, len(text) - width + 1))} if text else set()


class Statistics:
    """What the weights need to know of the whole benchmark."""

    def __init__(self, texts: list[list[bytes]]):
        self.items = len(texts)
        self.mean = sum(map(len, texts)) / max(1, len(texts))
        self.seen = Counter(w for t in texts for w in set(t))

    def weights(self, text: list[bytes]) -> dict[bytes, float]:
        """Of each word of an item, as a share of the item's score against itself."""
        out = {}
        for w, n in Counter(text).items():
            idf = math.log(1 + (self.items - self.seen[w] + 0.5) / (self.seen[w] + 0.5))
            out[w] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(text) / self.mean))
        own = sum(out.values())
        return {w: x / own for w, x in out.items()}


class Index:
    """Postings with impacts. Blocks are ranges of `block` items; of every list the largest impact in each block is kept."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.5, block: int = 4, known: Statistics | None = None):
        items = [(i, t) for i, t in items if t and split_words(t)]
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        texts = [q + a for q, a in self.parts]
        self.longest = max(map(len, texts), default=1)
        known = known or Statistics(texts)
        postings = defaultdict(list)
        for i, text in enumerate(texts):
            for w, x in known.weights(text).items():
                postings[w].append((i, x))
        terms = list(postings)
        raw = b"".join(terms)
        ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if terms else ends
        h = words.hashes(np.frombuffer(raw, np.uint8), starts, ends)
        order = np.argsort(h)
        self.hash, self.terms = h[order], [terms[k] for k in order]
        self.lists = [[i for i, _ in postings[t]] for t in self.terms]
        self.impacts = [[x for _, x in postings[t]] for t in self.terms]
        self.bound = [max(x) for x in self.impacts]
        self.block, n_blocks = block, -(-len(texts) // block)
        self.tops: list[dict[int, float]] = []  # by term: the largest impact in each block that has any
        for ids, impacts in zip(self.lists, self.impacts):
            best: dict[int, float] = {}
            for i, x in zip(ids, impacts):
                best[i // block] = max(best.get(i // block, 0.0), x)
            self.tops.append(best)
        #: Terms of many items are not looked up passage by passage: what they can add is part of every block's bound.
        free, common = np.zeros(len(texts)), np.zeros(len(self.terms), dtype=bool)
        for t in sorted(range(len(self.terms)), key=lambda t: -len(self.lists[t])):
            more = free.copy()
            more[self.lists[t]] += self.impacts[t]
            if len(self.lists[t]) <= 0.02 * len(texts) or more.max() > 0.6 * threshold:
                break
            free, common[t] = more, True
        self.free = np.zeros(n_blocks)
        np.maximum.at(self.free, np.arange(len(texts)) // block, free)
        tops: list[tuple[int, float]] = []
        self.top_start = np.zeros(len(self.terms) + 1, dtype=np.int64)
        for t, best in enumerate(self.tops):
            if not common[t]:
                tops += best.items()
            self.top_start[t + 1] = len(tops)
        self.top_block, self.top = np.array([g for g, _ in tops], dtype=np.int64), np.array([x for _, x in tops])
        self.filter = np.zeros(1 << 18, dtype=bool)
        self.filter[(self.hash & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of words of the index, and their terms."""
        where = np.flatnonzero(self.filter[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[where]), len(self.hash) - 1)
        ok = self.hash[at] == h[where]
        return where[ok], at[ok]

    def candidates(self, stretch: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Passages that could reach the threshold in some block. A passage is a stretch of words and the next one."""
        key = np.unique(stretch * len(self.terms) + term)
        stretch, term = key // len(self.terms), key % len(self.terms)
        n = self.top_start[term + 1] - self.top_start[term]
        at = np.arange(n.sum()) + np.repeat(self.top_start[term] - (np.cumsum(n) - n), n)
        stretch, block = np.repeat(stretch, n), self.top_block[at]
        key = np.concatenate([stretch * len(self.free) + block, (stretch - 1) * len(self.free) + block])
        order = np.argsort(key, kind="stable")
        key, top = key[order], np.concatenate([self.top[at]] * 2)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(top, first) if len(first) else np.zeros(0)
        passage, block = np.divmod(key[first], len(self.free))
        return np.unique(passage[total + self.free[block] >= threshold - 1e-9])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items that these distinct terms score at the threshold or above."""
        found, end = [], len(self.ids)
        cursors = [[self.lists[t][0], 0, t] for t in terms]  # item, place in the list, term
        threshold -= 1e-9
        while True:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (item, _, t) in enumerate(cursors):
                if item >= end:
                    break
                total += self.bound[t]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum(self.tops[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) < threshold:
                to = (block + 1) * self.block  # no item of this block that only these terms have can reach it
                if pivot + 1 < len(cursors):
                    to = max(item + 1, min(to, cursors[pivot + 1][0]))
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    ids = self.lists[c[2]]
                    k = bisect_left(ids, item, c[1])
                    if k < len(ids) and ids[k] == item:
                        score += self.impacts[c[2]][k]
                if score >= threshold:
                    found.append((item, score))
                to = item + 1
            for c in cursors[: pivot + 1]:
                ids = self.lists[c[2]]
                c[1] = bisect_left(ids, to, c[1])
                c[0] = ids[c[1]] if c[1] < len(ids) else end

    def verify(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        question, answer = self.parts[item]
        own, there = shingles(question), set(zip(*(passage[k:] for k in range(min(5, len(question))))))
        asked = len(own & there) / len(own) if own else 1.0
        known = set(answer)
        return asked, len(known & set(passage)) / len(known) if known else 1.0


def _repeats(indexes: list[Index], texts: pa.Array, threshold: float, overlap: float) -> dict[tuple[int, int, int], tuple]:
    """(score, question overlap, answer overlap) by (row, index, item of the index) for the verified ones."""
    data, offsets = words.text_buffer(pc.utf8_lower(texts))
    starts, ends, first = words.spans(data, offsets, words.ALNUM)
    hashed = words.hashes(data, starts, ends)
    best: dict[tuple[int, int, int], tuple] = {}
    for number, index in enumerate(indexes):
        step = index.longest
        where, term = index.find(hashed)
        doc = np.searchsorted(first, where, side="right") - 1
        base = np.concatenate([[0], np.cumsum(np.diff(first) // step + 2)])
        stretch = base[doc] + (where - first[doc]) // step
        passages = index.candidates(stretch, term, threshold)
        low, high = np.searchsorted(stretch, passages), np.searchsorted(stretch, passages + 2)
        for p, a, b in zip(passages.tolist(), low.tolist(), high.tolist()):
            d = int(doc[a])
            if p < base[d]:  # begins behind the last words of a document: the next passage is the same
                continue
            for item, score in index.search(np.unique(term[a:b]).tolist(), threshold):
                from_word = int(first[d]) + (p - int(base[d])) * step
                to_word = min(from_word + 2 * step, int(first[d + 1]))
                begin = int(starts[from_word])
                raw = data[begin : ends[to_word - 1]].tobytes()
                passage = [raw[s - begin : e - begin] for s, e in zip(starts[from_word:to_word].tolist(), ends[from_word:to_word].tolist())]
                asked, answered = index.verify(item, passage)
                if asked >= overlap and answered >= overlap:
                    best[d, number, item] = max(best.get((d, number, item), (0.0,)), (score, asked, answered))
    return best


def _scan(indexes: list[Index], threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 1):
            ids = batch.column(0).to_pylist()
            best = _repeats(indexes, batch.column(1), threshold, overlap)
            out = [(ids[d], i, *seen) for (d, number, item), seen in sorted(best.items()) for i in indexes[number].ids[item]]
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, most_words: int = 1_000_000) -> DataFrame:
    """A row for each row of docs and benchmark item that it repeats; clean documents have none.

    Of docs only doc_id and text are read, of benchmark item_id and text. Words are runs of letters and digits in
    lower case. Null and empty texts, and items without a word, match nothing. An item that occurs several times in
    a document is reported once, with its best passage; items of equal text, and repeated rows, are reported each. Very
    long texts are read whole, passage by passage. Ties in score make no difference, as all items above the threshold
    are found. Tasks hold indexes of about most_words words of the benchmark; a larger one is taken in parts, one pass
    over docs for each, with the same scores.
    """
    pairs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = []
    for indexes in _indexes(benchmark, threshold, most_words):
        held = docs.sparkSession.sparkContext.broadcast(indexes)
        scan = lambda batches, held=held: _scan(held.value, threshold, overlap)(batches)
        found.append(pairs.mapInArrow(scan, FOUND))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, most_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that repeat no benchmark item. Rows move between no tasks.

    Null and empty texts are clean and stay, and so do repeated clean rows. An empty table gives an empty result, an
    empty benchmark all rows. Columns may have any names.
    """
    for indexes in _indexes(benchmark, threshold, most_words):
        held = docs.sparkSession.sparkContext.broadcast(indexes)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in words.bounded(batches, "text"):
                good = np.ones(batch.num_rows, dtype=bool)
                good[[d for d, *_ in _repeats(held.value, batch.column("text"), threshold, overlap)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def _indexes(benchmark: DataFrame, threshold: float, most_words: int) -> Iterator[list[Index]]:
    """Lists of indexes, one for each class of item lengths, each list of about most_words words; item ids are lists.

    The benchmark is the small side: it is what evaluations hold, and it is read by the driver once. Items of equal text
    are one item with several ids.
    """
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("text IS NOT NULL")
    same = items.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("item_id"))).alias("ids"))
    held = [([i.item_id for i in r.ids], r.text, split_words(r.text)) for r in same.toLocalIterator()]
    held = sorted((h for h in held if h[2]), key=lambda h: (len(h[2]), h[1]))
    known = Statistics([text for *_, text in held])
    part, size = [], 0
    for h in held:
        if part and size + len(h[2]) > most_words:
            yield _classes(part, threshold, known)
            part, size = [], 0
        part.append(h)
        size += len(h[2])
    if part:
        yield _classes(part, threshold, known)


def _classes(items: list[tuple[list[int], str, list[bytes]]], threshold: float, known: Statistics) -> list[Index]:
    """Items of at most 64 words, 256 words and so on: a long item makes no short one's passages long."""
    of: dict[int, list] = defaultdict(list)
    for ids, text, split in items:
        of[max(0, -(-(len(split) - 1).bit_length() // 2) - 3) if len(split) > 1 else 0].append((ids, text))
    return [Index(of[k], threshold, known=known) for k in sorted(of)]
