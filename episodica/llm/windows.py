"""Packing of token ids into windows: best-fit decreasing over a segment tree of remaining capacities.

Rows longer than a window are cut into full windows and a rest. Pieces are dealt evenly to parts of a size that a task can
hold; each part packs its pieces by decreasing length, each into the tightest window that is open, which the tree finds by
the remaining capacity. What then lacks in windows is filled from the emptiest ones, whose pieces are cut where a window
is full; so one window of a part is left over, and that becomes windows whose lengths are powers of two. As a window with
a power of two of ids needs no padding, none is padded, unless `least` keeps pieces whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.tokens import Encoder, encoding, vocabulary_path

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"  # of two bytes each where the vocabulary allows it
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, sequence_tokens long"


def width(path: str, end: int) -> str:
    """The type in which ids go between tasks: two bytes if all ids are below 65,536, else four."""
    return "<u2" if max(encoding(path).n_vocab - 1, end) < 1 << 16 else "<u4"


def pieces(docs: DataFrame, capacity: int = 2048, end: int = 1, path: str | None = None) -> DataFrame:
    """The ids of every row of docs, then the id `end`, little-endian, as width() has them; longer rows in full windows and a rest."""
    path = path or vocabulary_path()
    kind = width(path, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = Encoder(path), np.array([end], "<u4").tobytes()
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "ids")])
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(encoder.ids(text.as_py() or "") + closing, "<u4").astype(kind)
                n = len(ids)
                for a in range(0, n, capacity):
                    b = min(a + capacity, n)
                    out.append((doc_id, a, b - a, n, ids[a:b].tobytes()))
                held += ids.nbytes
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, PIECE)


class OpenWindows:
    """The open windows by remaining capacity: a binary tree whose leaves are the capacities and whose nodes count windows."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.width + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(window, its room) with the least room that holds size, taken out of the tree; None if no window does."""
        count, node = self.count, self.width + size
        while not count[node]:  # up to the nearest node on the right that has windows, then down to its leftmost leaf
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.width
        self._add(room, -1)
        return self.windows[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; equal sizes go in their order."""
    tree, out, made = OpenWindows(capacity), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if (found := tree.take(size)) is None:
            found, made = (made, capacity), made + 1
        out[i] = found[0]
        if found[1] > size:
            tree.put(found[0], found[1] - size)
    return out


def closed(sizes: np.ndarray, window: np.ndarray, capacity: int, least: int = 1) -> list[list[tuple[int, int, int]]]:
    """The windows as lists of (piece, from, to) after filling what lacks `least` ids or more from the emptiest windows."""
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(int(window.max(initial=-1)) + 1)]
    for i, w in enumerate(window.tolist()):
        held[w].append((i, 0, int(sizes[i])))
    used = np.bincount(window, weights=sizes, minlength=len(held)).astype(np.int64)
    short = [w for w in np.argsort(used, kind="stable").tolist() if capacity - used[w] >= least]
    # The first `give` windows are emptied into the others: as few as have the ids that the others lack.
    had, lack = np.cumsum([0, *used[short]]), np.cumsum([0, *(capacity - used[short])[::-1]])[::-1]
    give = int(np.argmax(had >= lack))
    pour = [span for w in short[:give] for span in held[w]][::-1]
    for w in short[give:]:
        room = int(capacity - used[w])
        while room:
            i, a, b = pour.pop()
            cut = min(b, a + room)
            held[w].append((i, a, cut))
            room -= cut - a
            if cut < b:
                pour.append((i, cut, b))
    gone = set(short[:give])
    out = [spans for w, spans in enumerate(held) if w not in gone]
    left = sum(b - a for _, a, b in pour)
    lengths = [capacity] * (left // capacity)
    rest = left % capacity
    lengths += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1] if rest >= least else [rest] * bool(rest)
    for room in lengths:
        spans: list[tuple[int, int, int]] = []
        while room:
            i, a, b = pour.pop()
            cut = min(b, a + room)
            spans.append((i, a, cut))
            room -= cut - a
            if cut < b:
                pour.append((i, cut, b))
        out.append(spans)
    return out


def _pack(capacity: int, least: int, kind: str):
    def run(part: pa.Table) -> pa.Table:
        number = part["part"][0].as_py()
        order = ["doc_id", "start", "length", "doc_tokens", "ids"]
        part = part.select(order).combine_chunks().sort_by([(c, "ascending") for c in order[:4]])
        doc, start, total = (part[c].combine_chunks() for c in ("doc_id", "start", "doc_tokens"))
        start = start.to_numpy()
        ids, sizes = part["ids"], part["length"].to_numpy()
        windows = closed(sizes, best_fit_decreasing(sizes, capacity), capacity, least)
        piece, a, b, window, offset, tokens = [], [], [], [], [], []
        for w, spans in enumerate(windows):
            at, whole = 0, sum(y - x for _, x, y in spans)
            for i, x, y in spans:
                piece.append(i), a.append(x), b.append(y), window.append(w), offset.append(at), tokens.append(whole)
                at += y - x
        piece, a, b = (np.array(x, np.int64) for x in (piece, a, b))
        cut = [np.frombuffer(ids[i].as_buffer(), kind)[x:y].astype("<u4").tobytes() for i, x, y in zip(piece.tolist(), a.tolist(), b.tolist())]
        columns = [doc.take(pa.array(piece)), start[piece] + a, b - a, total.take(pa.array(piece)), pa.array(cut, pa.binary()), (number << 32) + np.array(window, np.int64), offset, tokens]
        names = [*order, "sequence_id", "offset", "sequence_tokens"]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack(docs: DataFrame, capacity: int = 2048, end: int = 1, path: str | None = None, least: int = 1, part_bytes: int = 1 << 24, part_rows: int = 100_000) -> DataFrame:
    """Packs every row of docs into windows of at most capacity ids: a row per piece, with its ids and its place.

    The capacity is a power of two. sequence_tokens is the number of ids in the piece's window: the capacity, or another
    power of two. With `least` above 1 windows that lack fewer ids stay so, and so does a last window of fewer ids.
    Parts hold about part_bytes of text and part_rows rows, whatever the table's size.

    Only doc_id and text are read. A null or empty text is the single id `end`. A very long text is encoded in one task
    and dealt in windows to many. Rows with null or repeated ids and equal rows are packed like others; equal lengths are
    taken in the order of doc_id and start. An empty table gives an empty result.
    """
    path = path or vocabulary_path()
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(docs["text"])), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    parts = max(1, -(-size["size"] // part_bytes), -(-size["rows"] // part_rows))
    where = F.xxhash64("doc_id", "start", F.monotonically_increasing_id())  # rows of one id part by their place
    dealt = pieces(docs, capacity, end, path).withColumn("part", F.pmod(where, F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(_pack(capacity, least, width(path, end)), PACKED)
