"""SimHash near-duplicates: fingerprints, a binary-trie self-join, and connected components.

The join is exact. The 64 bits are cut into six blocks; two fingerprints that differ in at
most four bits agree on at least two whole blocks, so they meet under one of the fifteen
pairs of blocks. All fingerprints that agree on a pair of blocks form one trie, and a task
walks the node pairs of its tries together: a pair of nodes carries the bits in which its
members differ so far and is dropped once they exceed the budget, or once all their members
are linked already. A task returns no pairs but a path through what it has linked, so no
node gets many edges.

Equal texts are one fingerprint before the join, so exact copies cost nothing there. A trie
of more than `cell` fingerprints is dealt out as pairs of its parts, each to a task of its own.

`first_of_each` is the same join for texts alike by 0.8 in runs of five words. Their
fingerprints differ in up to 24 bits, too many for blocks to meet on, so a trie holds what
agrees on a min-hash band, and every pair that the walk keeps is verified on the texts, but for
those whose sizes or whose 1,024 parities say for certain that they are not alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm import shingles, words
from episodica.llm.tables import cut, join_hot, shards, small

#: Bits in which sets alike by 0.8 may differ: five standard deviations above the mean.
NEAR = 24
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # lowest bit, width
BUDGET = 4


def fingerprint(text: bytes, width: int = 4) -> int:
    """Of a UTF-8 text, as a signed 64-bit number."""
    parts = text.lower().split()  # bytes: only A-Z change, and white space is \x20 and \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= width:
        value = xxhash.xxh64_intdigest(joined, seed=42)
        return value - (1 << 64) if value >> 63 else value
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: len(parts) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    values = [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())]
    bits = np.unpackbits(np.array(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(values)
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = pa.array([fingerprint((t or "").encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "fp"])

    pairs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return pairs.mapInArrow(run, "doc_id long, fp long")


def _bands() -> Column:
    """One struct for each pair of blocks: which pair, and the bits of both."""

    def block(k: int) -> Column:
        low, width = BLOCKS[k]
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    pairs = combinations(range(len(BLOCKS)), 2)
    return F.array(
        *(F.struct(F.lit(i).alias("band"), F.shiftleft(block(a), 11).bitwiseOR(block(b)).alias("key")) for i, (a, b) in enumerate(pairs))
    )


def links(distinct: DataFrame, cell: int = 8192, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) that connect the fingerprints in column fp exactly as all pairs within the budget would."""
    banded = distinct.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("label"), F.inline(_bands()))
    return _dealt(banded, cell).mapInArrow(lambda batches: _paths(batches, budget), "a long, b long").distinct()


def _dealt(banded: DataFrame, cell: int, *more: str) -> DataFrame:
    """Rows (node, fp, label, band, key, and more) in the order of their tries: by band and key; keys of more than `cell` rows
    as pairs of parts."""
    large = banded.groupBy("band", "key").count().where(F.col("count") > cell)
    large = large.select("band", "key", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    dealt = banded.join(large, ["band", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", "key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "fp", "node", "label", *more)
    trie = ("band", "key", "x", "y")
    return dealt.repartition(shards(banded.sparkSession), *trie).sortWithinPartitions(*trie)


def _some_tries(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.Table]:
    """The rows of a task in tables of whole tries, of about `most` rows: a task holds that and one trie, however many rows it has."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        table = pa.Table.from_batches(held)
        trie = [table[k].to_numpy() for k in range(4)]
        new = np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in trie)))
        if len(new):
            last = int(new[-1]) + 1  # the last trie may go on
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


class _Tries:
    """Some whole tries: sorted leaves, where they stand in the table, and the pairs of roots to walk."""

    def __init__(self, table: pa.Table):
        band, key, x, y, part, fp, node, label = (table[k].to_numpy() for k in range(8))
        bits = fp.view(np.uint64)
        self.order = order = np.lexsort((node, bits, part, y, x, key, band))
        band, key, x, y, part, self.bits, self.node, self.label = (c[order] for c in (band, key, x, y, part, bits, node, label))
        changed = lambda *cs: np.concatenate([[True], reduce(np.logical_or, (c[1:] != c[:-1] for c in cs))])[: len(bits)]
        trie = np.flatnonzero(changed(band, key, x, y))
        half = np.flatnonzero(changed(band, key, x, y, part))
        end = np.append(half[1:], len(bits))[: len(half)]
        whole = np.isin(half, trie)
        alone = whole & (x[half] == y[half])
        second = np.flatnonzero(~whole)  # the other part of a trie that is dealt out, next to its first part
        some = alone & (end - half > 1)
        self.roots = [(half[some], end[some], half[some], end[some])]
        self.roots.append((half[second - 1], end[second - 1], half[second], end[second]))
        self.same_trie = ~changed(band, key, x, y)
        self._count_changes()

    def _count_changes(self) -> None:
        change = np.concatenate([[False], self.label[1:] != self.label[:-1]])[: len(self.label)]
        self.changes = np.cumsum(change)

    def relabel(self, label: np.ndarray) -> None:
        self.label = label
        self._count_changes()

    def one_label(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        """Pairs of nodes all of whose members have one label."""
        pure = (self.changes[hi1 - 1] == self.changes[lo1]) & (self.changes[hi2 - 1] == self.changes[lo2])
        return pure & (self.label[lo1] == self.label[lo2])

    def near(self, budget: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves within the budget whose labels differ (at the time), by walking pairs of nodes together."""
        bits, ones = self.bits, {}
        for roots in self.roots:
            stack = [(0, *roots, np.zeros(len(roots[0]), np.int8))]
            while stack:
                depth, *pairs = stack.pop()
                if len(pairs[0]) > at_once:
                    stack.append((depth, *(p[at_once:] for p in pairs)))
                    pairs = [p[:at_once] for p in pairs]
                keep = ~self.one_label(*pairs[:4]) if len(pairs[0]) else slice(0)
                lo1, hi1, lo2, hi2, differ = (p[keep] for p in pairs)
                single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
                a, b = lo1[single], lo2[single]
                close = np.bitwise_count(bits[a] ^ bits[b]) <= budget
                if close.any():
                    yield a[close], b[close]
                lo1, hi1, lo2, hi2, differ = (p[~single] for p in (lo1, hi1, lo2, hi2, differ))
                if not len(lo1):
                    continue
                if depth == 64:  # equal fingerprints: every leaf of the one node with every leaf of the other
                    for p, q, r, t in zip(lo1.tolist(), hi1.tolist(), lo2.tolist(), hi2.tolist()):
                        for a in range(p, q):
                            b = np.arange(max(a + 1, r), t) if p == r else np.arange(r, t)
                            b = b[self.label[b] != self.label[a]]
                            if len(b):
                                yield np.full(len(b), a), b
                    continue
                if depth not in ones:
                    bit = (bits >> np.uint64(63 - depth)) & np.uint64(1)
                    ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
                count = ones[depth]
                mid1, mid2 = hi1 - (count[hi1] - count[lo1]), hi2 - (count[hi2] - count[lo2])
                same = lo1 == lo2
                below = [(lo1, mid1, lo2, mid2, differ), (mid1, hi1, mid2, hi2, differ), (lo1, mid1, mid2, hi2, differ + 1)]
                below.append(tuple(p[~same] for p in (mid1, hi1, lo2, mid2, differ + 1)))
                lo1, hi1, lo2, hi2, differ = (np.concatenate(c) for c in zip(*below))
                keep = (hi1 > lo1) & (hi2 > lo2) & (differ <= budget) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
                if keep.any():
                    stack.append((depth + 1, *(p[keep] for p in (lo1, hi1, lo2, hi2, differ))))


def _paths(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """For each set of leaves that pairs within the budget connect, a path through it."""
    for table in _some_tries(batches):
        tries = _Tries(table)
        n = len(tries.bits)
        parent = np.arange(n)
        beside = np.flatnonzero(tries.same_trie[1:] & (np.bitwise_count(tries.bits[1:] ^ tries.bits[:-1]) <= budget))
        parent = _union(parent, beside, beside + 1)
        tries.relabel(parent)
        for a, b in tries.near(budget):
            parent = _union(parent, a, b)
            tries.relabel(parent)
        order = np.lexsort((np.arange(n), parent))
        next_to = np.flatnonzero(parent[order][1:] == parent[order][:-1])
        a, b = tries.node[order[next_to]], tries.node[order[next_to + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch], budget: int, like: float) -> Iterator[tuple[_Tries, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of leaves within the budget that have unlike labels and whose sizes and parities allow them to be alike, and
    how far they are below what these allow. No pair that is alike is left out. Most pairs that meet here are different
    texts around one common passage; no text is read to tell them apart."""
    for table in _some_tries(batches):
        tries = _Tries(table)
        size = table["size"].to_numpy()[tries.order]
        held, width = table["odd"].combine_chunks(), shingles.PARITIES // 8
        odd = np.frombuffer(held.buffers()[2], np.uint8)[held.offset * width :][: len(held) * width].reshape(-1, width)[tries.order].view(np.uint64)
        for at, to in tries.near(budget, 1 << 16):
            some = np.flatnonzero(np.minimum(size[at], size[to]) >= like * np.maximum(size[at], size[to]))
            at, to = at[some], to[some]
            below = shingles.most_apart(size[at], size[to], like) - np.bitwise_count(odd[at] ^ odd[to]).sum(1, dtype=np.int64)
            some = np.flatnonzero(below >= 0)
            yield tries, at[some], to[some], below[some]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _apart(batches: Iterator[pa.RecordBatch], budget: int, like: float) -> Iterator[pa.RecordBatch]:
    """All likely pairs."""
    for tries, at, to, _ in _likely(batches, budget, like):
        yield _pairs(tries.node[at], tries.node[to])


def _best(batches: Iterator[pa.RecordBatch], budget: int, like: float) -> Iterator[pa.RecordBatch]:
    """Of each leaf the likely pair that is the furthest below what is allowed: no more pairs than leaves, and those that link the most.

    In a group of copies of one text that is the pair with the text itself, which links all of them.
    """
    held, best = None, np.zeros(0, np.int64)

    def found() -> pa.RecordBatch:
        leaf = np.flatnonzero(best >= 0)
        return _pairs(held.node[leaf], held.node[best[leaf] & 0xFFFFFFFF])

    for tries, at, to, below in _likely(batches, budget, like):
        if tries is not held:
            if held is not None:
                yield found()
            held, best = tries, np.full(len(tries.node), -1)
        np.maximum.at(best, at, below << 32 | to)
        np.maximum.at(best, to, below << 32 | at)
    if held is not None:
        yield found()


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parent = parent.copy()
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    return parent


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A name of the component of each node of the edges."""
    held = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(c) for c in zip(*held))
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = _union(np.arange(len(node)), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[parent])], ["node", "root"])


def components(edges: DataFrame, nodes: DataFrame, few: int = 500_000) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least label of its component, which names the node it is of.

    nodes has node and label, a struct that ends in that node and orders the nodes. Up to `few` edges are linked in one
    task and broadcast, as any table of a checked size may be. More are linked in rounds: each takes the least label
    among the neighbours and then the label of the node that it names, so chains shorten by half; every round is
    checkpointed. Many nodes that name one go by broadcast, so a large component fills no task.
    """
    edges = cut(edges)
    if small(edges, few):
        found = edges.coalesce(1).mapInArrow(_roots, "node long, root long")
        named = cut(nodes.join(F.broadcast(found), "node").select("node", "root", "label"))
        least = named.groupBy("root").agg(F.min("label").alias("label"))
        return named.select("node", "root").join(F.broadcast(least), "root").select("node", "label")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.join(both.select(F.col("a").alias("node")).distinct(), "node").select("node", "label"))
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("least"))
        near = labels.join(told, labels["node"] == told["to"]).select("node", F.col("label").alias("was"), F.least("label", "least").alias("near"))
        near = cut(near.withColumn("via", F.col("near.node")))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("up"))
        new = cut(join_hot(near, up, "via").select("node", "was", F.least("near", "up").alias("label")))
        if new.where("label < was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, cell: int = 8192) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable) of every row of docs.

    Only doc_id and text are read. Null and empty texts have the fingerprint zero and link like others; a row
    with a null doc_id links too, but cannot name a component (null, if no row of the component has an id).
    A bit that exactly half of the shingles set is 0. Very long texts are read whole, in one task each. Repeated rows
    stay. An empty table gives an empty result.
    """
    held = cut(fingerprints(docs))
    classes = cut(held.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = F.struct(F.col("first").isNull().alias("nameless"), "first", F.col("fp").alias("node"))
    found = components(links(classes.select("fp"), cell), classes.select(F.col("fp").alias("node"), label.alias("label")))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", F.coalesce("label.first", "first").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return join_hot(held, cut(named), "fp").select("doc_id", hexed, "component_id")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.bounded(batches, 2):
        value, size = shingles.sets(batch.column(2))
        ends = np.concatenate([[0], np.cumsum((size > 0) * shingles.BANDS)])
        least = shingles.minima(value, size)
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shingles.bands(least).reshape(-1)))
        places = pa.array(np.arange(len(size) + 1) * (shingles.PARITIES // 8), pa.int32())
        odd = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, places.buffers()[1], pa.py_buffer(shingles.parities(value, size).tobytes())])
        made = [pa.array(shingles.prints(value, size)), pa.array(shingles.simhashes(value, size)), keys, pa.array(size.astype(np.int64)), odd]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "mark", "print", "fp", "keys", "size", "odd"])


def _alike(batches: Iterator[pa.RecordBatch], like: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, text of a, text of b) whose sets are alike."""
    for whole in batches:
        for batch in words.bounded(words.bounded([whole], 2), 3):
            x, n = shingles.sets(batch.column(2))
            y, m = shingles.sets(batch.column(3))
            row = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
            order = np.lexsort((np.concatenate([x, y]), np.concatenate(row)))
            value, row = np.concatenate([x, y])[order], np.concatenate(row)[order]
            twice = np.flatnonzero((value[1:] == value[:-1]) & (row[1:] == row[:-1]))
            both = np.bincount(row[twice], minlength=len(n))
            yield batch.select([0, 1]).filter(pa.array(both >= like * (n + m - both)))


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, like: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets are alike; a class is read from its first row."""
    pairs = cut(pairs)
    nodes = cut(classes.join(pairs.select(F.col("a").alias("print")).union(pairs.select("b")).distinct(), "print", "left_semi").select("print", "id", "mark"))
    wanted = F.broadcast(nodes) if small(nodes) else nodes
    texts = rows.join(wanted, ["id", "mark"]).groupBy("print").agg(F.first("text").alias("text"))
    texts = cut(texts)
    left, right = texts.select(F.col("print").alias("a"), F.col("text").alias("x")), texts.select(F.col("print").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(lambda batches: _alike(batches, like), "a long, b long"))


def first_of_each(docs: DataFrame, like: float = shingles.LIKE, cell: int = 8192) -> DataFrame:
    """docs with one row for each component of near copies: the row of its smallest doc_id, or without ids one of the others.

    Copies are texts whose sets of five-word runs have a Jaccard similarity of `like` or more. A first walk of the tries
    gives paths through what may be alike; of what verification leaves apart first the likeliest pairs are verified, and
    then all others that sizes and parities allow. Of rows with that doc_id the least by a hash of all columns stays. Null and empty texts are copies of each other, texts of fewer
    than five words are one run. Rows of one id with unlike texts are rows of different components. Columns may have
    any names. An empty table gives an empty result.
    """
    mark = F.xxhash64(*(docs[c] for c in docs.columns))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), mark.alias("mark"), docs["text"].alias("text"))
    held = cut(rows.mapInArrow(_signed, "id long, mark long, print long, fp long, keys array<long>, size long, odd binary"))
    place = F.struct((F.col("id") == -(1 << 63)).alias("nameless"), "id", "mark")
    classes = held.groupBy("print").agg(F.min(place).alias("place"), *(F.first(c).alias(c) for c in ("fp", "keys", "size", "odd")))
    classes = cut(classes.select("print", "place", "place.id", "place.mark", "fp", "keys", "size", "odd"))

    def banded(of: DataFrame, *more: str) -> DataFrame:
        return of.select(F.col("print").alias("node"), "fp", "label", F.lit(0).alias("band"), F.explode("keys").alias("key"), *more)

    nodes = classes.select(F.col("print").alias("node"), F.struct("place.nameless", "place.id", "place.mark", F.col("print").alias("node")).alias("label"))
    paths = _dealt(banded(classes.withColumn("label", F.col("print"))), cell).mapInArrow(lambda batches: _paths(batches, NEAR), "a long, b long")
    paths = cut(paths.distinct())
    edges = _verified(paths, classes, rows, like)
    found = components(edges, nodes)
    # Only what a path leads through can have another partner. The likeliest partner of each is tried first, as that links
    # most of what is to be linked; then all other likely pairs of what is not linked.
    on_path = cut(classes.join(paths.select(F.col("a").alias("print")).union(paths.select("b")).distinct(), "print", "left_semi"))
    done = paths
    for walk in (_best, _apart):
        labels = found.select(F.col("node").alias("print"), F.col("label.node").alias("label"))
        asked = cut(on_path.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print")))
        likely = _dealt(banded(asked, "size", "odd"), cell, "size", "odd").mapInArrow(lambda batches, walk=walk: walk(batches, NEAR, like), "a long, b long")
        likely = cut(likely.distinct().join(done, ["a", "b"], "left_anti"))
        if not likely.isEmpty():
            more, done = _verified(likely, classes, rows, like), done.union(likely)
            if not more.isEmpty():
                edges = edges.union(more)
                found = components(edges, nodes)
    gone = found.where("node <> label.node").select(F.col("node").alias("print"))
    kept = classes.join(gone, "print", "left_anti").select("id", "mark")
    return _only(docs, mark, held, cut(kept))


def _only(docs: DataFrame, mark: Column, held: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs with an id and mark in kept, each once."""
    of = {"kept id": F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)).cast("long")), "kept mark": mark}
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in of.items()))
    rename = lambda df: df.select(F.col("id").alias("kept id"), F.col("mark").alias("kept mark"))
    counts = cut(rename(held).groupBy("kept id", "kept mark").agg(F.count(F.lit(1)).alias("times")))
    dropped = counts.join(rename(kept), list(of), "left_anti").select(*of)
    rows = rows.join(F.broadcast(dropped), list(of), "left_anti") if small(dropped) else rows.join(rename(kept), list(of), "left_semi")
    repeated = cut(counts.where("times > 1").join(rename(kept), list(of), "left_semi").select(*of))
    if not repeated.isEmpty():
        repeated = F.broadcast(repeated) if small(repeated) else repeated
        once = rows.join(repeated, list(of), "left_semi").groupBy(*of).agg(F.first("row").alias("row"))
        rows = rows.join(repeated, list(of), "left_anti").select("row").unionByName(once.select("row"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
