"""Best-fit packing of token sequences, certified by dual-feasible lower bounds.

Documents are cut into pieces, and the pieces are dealt evenly, to parts of a size that a task can
hold. Every part packs its pieces by best-fit decreasing and compares its number of sequences with
a lower bound. Full sequences stay. A part gives up the pieces of its emptiest sequences, a few if
it meets its bound (which rounds up in every part) and more the larger its gap; those of all parts
are exchanged and packed again in as few parts as can hold them, until one part is left or an
exchange no longer makes them fewer. Each row carries its part's number of sequences and bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.tables import cut
from episodica.llm.tokens import Encoder, vocabulary_path

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
COLUMNS = [*PIECE_COLUMNS, "sequence_id", "offset", "round", "part", "part_sequences", "part_bound"]
PACKED = PIECE + ", sequence_id long, offset long, round int, part int, part_sequences long, part_bound long"


def pieces(docs: DataFrame, capacity: int = 1024, end: int = 2, path: str | None = None) -> DataFrame:
    """The pieces of every row of docs: its ids, then the id `end`; a longer row is cut so that only its first piece is short."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = Encoder(path), np.uint32(end).tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + closing
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names)

    pairs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return pairs.mapInArrow(run, PIECE)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of the sizes needs fewer sequences: the best of two families of dual-feasible functions."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for least in range(1, capacity // 2 + 1):  # small sizes weigh nothing, those that exclude them a whole sequence
        weight = np.where(x < least, 0, np.where(x > capacity - least, capacity, x))
        best = max(best, -(-int((count * weight).sum()) // capacity))
    for k in range(1, 33):  # rounds (k + 1) x down to whole parts of 1 / k
        scaled = (k + 1) * x
        weight = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, when sizes go in decreasing order into the fullest bin that still has room."""
    bins = np.empty(len(sizes), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r of rooms: there is a bin with room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room, made = made, capacity, made + 1
        bins[i] = b
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def _pack_part(number: int, capacity: int, last: bool):
    """Packs a part of one round; sequence -1 marks pieces that are given up for the next round."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in PIECE_COLUMNS])
        size = part["length"].to_numpy()
        bins = best_fit(size, capacity)
        used = np.bincount(bins, weights=size).astype(np.int64)
        bound = lower_bound(size, capacity)
        order = np.lexsort((np.arange(len(size)), bins))
        before = np.concatenate([[0], np.cumsum(size[order])[:-1]])
        offset = np.empty(len(size), dtype=np.int64)
        offset[order] = before - np.concatenate([[0], np.cumsum(used)[:-1]])[bins[order]]
        sequence = (number << 56) + (part["part"].to_numpy().astype(np.int64) << 32) + bins
        if not last:
            order = np.argsort(used, kind="stable")
            order = order[used[order] < capacity]  # a full sequence cannot get better
            sequence[np.isin(bins, order[: 16 * (len(used) - bound) + 16])] = -1
        every = lambda value, kind: pa.array(np.full(len(size), value), kind)
        columns = [*(part[c] for c in PIECE_COLUMNS), pa.array(sequence), pa.array(offset), every(number, pa.int32()), part["part"]]
        return pa.Table.from_arrays([*columns, every(len(used), pa.int64()), every(bound, pa.int64())], COLUMNS)

    return run


def pack(pieces_: DataFrame, capacity: int = 1024, part_pieces: int = 50_000, most_rounds: int = 8) -> DataFrame:
    """Gives every piece a sequence_id and an offset; in each sequence offsets run gapless from 0 up to the capacity.

    A part holds about part_pieces pieces, whatever the table's size. A round that passes on as much as it got is the
    last one, and so is round most_rounds; pieces are never dropped, they stay where they are packed.
    """
    number, done, left, held = 1, [], pieces_, pieces_.count()
    while held:
        n = -(-held // part_pieces)
        where = F.xxhash64(*PIECE_COLUMNS, F.monotonically_increasing_id())  # rows alike in all columns part by their place
        dealt = left.withColumn("part", F.pmod(where, F.lit(n)).cast("int"))
        last = n == 1 or number == most_rounds
        packed = cut(dealt.groupBy("part").applyInArrow(_pack_part(number, capacity, last), PACKED))
        done.append(packed.where("sequence_id >= 0"))
        left = packed.where("sequence_id < 0").select(*PIECE_COLUMNS)
        passed = 0 if last else left.count()
        if passed and -(-passed // part_pieces) >= n:
            number = most_rounds - 1  # an exchange that makes no fewer parts is followed by the last one
        held, number = passed, number + 1
    return reduce(DataFrame.unionByName, done) if done else pieces_.sparkSession.createDataFrame([], PACKED)


def best_fit_packing(docs: DataFrame, capacity: int = 1024, end: int = 2, path: str | None = None, part_pieces: int = 50_000) -> DataFrame:
    """Packs every row of docs into sequences of at most capacity tokens; a row per piece.

    Only doc_id and text are read. A null or empty text is the single id `end`; a very long text is cut into many pieces,
    and its ids are held by one task while it is encoded. Rows with null or repeated ids, and equal rows, are packed
    like others. An empty table gives an empty result. part_sequences and part_bound are those of the part in which the
    piece was packed: no packing of that part's pieces has fewer sequences than part_bound.
    """
    return pack(cut(pieces(docs, capacity, end, path)), capacity, part_pieces)
