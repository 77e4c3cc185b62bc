"""Language-model scoring: an interpolated modified Kneser-Ney model of any order, three by default.

Every document is scored under the model of the training documents. The model is never stored as such: chunks of documents
ask shards of the n-grams, and each shard answers every chunk. It is made order by order, from the highest down:

1. Documents are grouped into chunks and written to the shared folder once, so that every later
   step sees the same chunks whatever happens to a task.
2. Each chunk sends the sorted hashes of its distinct n-grams, with their counts in training documents, to the shard of
   the hash. A shard adds them up and answers each chunk in the order of its hashes: the counts of the whole corpus, and
   whether it is the first chunk that has the n-gram in training, which makes it the n-gram's owner.
3. For the next order each chunk again sends its distinct n-grams, with what the longer ones that it owns, so each n-gram
   of the corpus once, say of their last n - 1 words (one more word before them) and of their first n - 1 (one more
   follower, seen once, twice or more often); again shards add up and answer.
4. At last each chunk reads its answers of all orders and sums the probabilities of its documents' tokens.

A chunk's n-grams and their order follow from its texts, so answers hold no hashes, only small numbers, and nothing is
searched: an answer is as long as its question. Questions travel compressed, once for each chunk that has the n-gram; answers
are a file for each order and shard in the shared folder, of which a chunk reads its own part. Shards
are ranges of the hash of the whole n-gram, so no word owns one, and their number grows with the corpus.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm import words
from episodica.llm.tables import brief_shuffles, cut, shared_folder

BEGIN, END = np.uint64(1), np.uint64(2)  # stand before the first word and after the last one
BLOB = "shard long, chunk long, blob binary"
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
TOP = ("count",)  # of n-grams of the highest order
#: Of shorter ones: different words before, and as beginnings: sum of counts, followers of count one, two, more; single words' counts.
LOWER = ("before", "total", "ones", "twos", "more", "count")


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers in their least width, the first array, which is sorted, as differences; compressed."""
    first, *rest = arrays
    out = io.BytesIO()
    steps = np.diff(first.astype(np.uint64), prepend=np.uint64(0))
    np.save(out, np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))  # high bytes, mostly zeros, stand together
    for a in rest:
        np.save(out, narrow(a))
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack(blob: bytes, arrays: int) -> list[np.ndarray]:
    held = io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))
    steps = np.ascontiguousarray(np.load(held).T).reshape(-1).view(np.uint64)
    return [np.cumsum(steps, dtype=np.uint64), *(np.load(held).astype(np.int64) for _ in range(arrays))]


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the least width that holds all of them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(next(kind for kind in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(kind).max))


def pack_numbers(arrays: Iterable[np.ndarray]) -> bytes:
    """Whole numbers, none negative, in any order; compressed, high bytes, mostly zeros, together."""
    out = io.BytesIO()
    for a in map(narrow, arrays):
        np.save(out, np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T))
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack_numbers(blob: bytes, arrays: int) -> list[np.ndarray]:
    """The first arrays of those packed, as narrow as they were."""
    held = io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))
    planes = (np.load(held) for _ in range(arrays))
    return [np.ascontiguousarray(p.T).reshape(-1).view(f"u{len(p)}") for p in planes]


def held_out(doc_id: int | None, modulus: int = 10) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == 0


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted hashes are sorted by shard."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _posix(folder: str) -> str:
    """The shared folder as workers open it."""
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError(f"workers read the model from a mounted folder; {folder} is none: mount it and set spark.checkpoint.dir to its path")
    return place.path


class Answers:
    """What the shards of one order tell the chunks: a file for each shard, in which every chunk has a part."""

    def __init__(self, folder: str, order: int, n_shards: int, names: tuple[str, ...]):
        self.folder, self.n_shards, self.names = f"{folder}/order-{order}", n_shards, names

    def write(self, shard: int, chunks: np.ndarray, parts: Iterable[bytes]) -> None:
        """Chunks are sorted. The file appears whole or not at all; a repeated task writes the same one."""
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{shard}.answers"
        part, ends = f"{path}.{uuid.uuid4().hex}", []
        with open(part, "wb") as file:
            np.save(file, np.zeros((2, len(chunks)), dtype=np.int64))
            for blob in parts:
                file.write(blob)
                ends.append(file.tell())
            file.seek(0)
            np.save(file, np.stack([chunks, np.array(ends, dtype=np.int64)]))
        os.replace(part, path)

    def read(self, chunk: int, size: int, names: int | None = None) -> list[np.ndarray]:
        """Is the chunk the owner, and the numbers (the first `names` of them, or all) of its `size` n-grams."""
        count = 1 + (len(self.names) if names is None else names)
        found = [[np.zeros(0, np.uint8)] * count]
        for shard in range(self.n_shards):
            path = f"{self.folder}/{shard}.answers"
            if not os.path.exists(path):  # no chunk has n-grams there
                continue
            with open(path, "rb") as file:
                chunks, ends = np.load(file)
                k = int(np.searchsorted(chunks, chunk))
                if k < len(chunks) and chunks[k] == chunk:
                    start = int(ends[k - 1]) if k else file.tell()
                    file.seek(start)
                    found.append(unpack_numbers(file.read(int(ends[k]) - start), count))
        out = [np.concatenate(c) for c in zip(*found)]
        if len(out[0]) != size:
            raise OSError(f"{self.folder} answers {len(out[0])} of the {size} n-grams of chunk {chunk}")
        return out


def _changes(a: np.ndarray) -> np.ndarray:
    """Marks the first of equal values of a sorted array; numpy's unique hashes, which takes many times as long here."""
    new = np.ones(len(a), dtype=bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return new


class Grams:
    """Distinct n-grams of a chunk, sorted by hash: the one that each token ends, and the one that ends just before it."""

    def __init__(self, hashed: np.ndarray, begins: np.ndarray, learned: np.ndarray, beginning: np.ndarray):
        """beginning is the n-gram of BEGIN alone; begins marks the tokens that it stands before."""
        every = np.concatenate([hashed, beginning])
        order = np.argsort(every)
        every = every[order]
        new = _changes(every)
        self.hash, at = every[new], np.empty(len(every), dtype=np.uint32)
        del every
        at[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        self.at, self._beginning, self._begins, self._learned = at[:-1], at[-1], begins, learned

    @property
    def before(self) -> np.ndarray:
        return np.where(self._begins, self._beginning, np.roll(self.at, 1))

    @property
    def count(self) -> np.ndarray:
        return np.bincount(self.at[self._learned], minlength=len(self.hash))

    def example(self, wanted: np.ndarray) -> np.ndarray:
        """A training token that ends it, of each wanted n-gram."""
        place, learned = np.full(len(self.hash), -1), np.flatnonzero(self._learned)
        place[self.at[learned]] = learned
        return place[wanted]


class Chunk:
    """The tokens of some documents, and the n-grams that end at each of them."""

    def __init__(self, blob: bytes):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
        self.ids, column = table["doc_id"].to_pylist(), table["text"].combine_chunks()
        self.token, self.n_tokens = _tokens(column)
        self.start = np.cumsum(self.n_tokens) - self.n_tokens
        self.held = np.array([held_out(i) for i in self.ids], dtype=bool)
        self.learned = np.repeat(~self.held, self.n_tokens)

    def grams(self, n: int) -> Grams:
        """Of the n words up to each token; BEGIN stands before a document's first word."""
        place = np.arange(len(self.token)) - np.repeat(self.start, self.n_tokens)
        word = lambda k: np.where(place >= k, np.roll(self.token, k), BEGIN)
        hashed, beginning = word(n - 1), np.array([BEGIN])
        for k in range(n - 2, -1, -1):
            hashed, beginning = words.pair(hashed, word(k)), words.pair(beginning, np.array([BEGIN]))
        return Grams(hashed, place == 0, self.learned, beginning)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the number of tokens of each text."""
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for part in words.bounded([batch], 0):
        data, offsets = words.text_buffer(part.column(0))
        data = words.ASCII_LOWER[data]
        starts, ends, first = words.spans(data, offsets, words.NOT_SPACE)
        token = np.full(len(starts) + part.num_rows, END, dtype=np.uint64)
        token[np.arange(len(starts)) + np.repeat(np.arange(part.num_rows), np.diff(first))] = words.hashes(data, starts, ends)
        found.append(token)
        sizes.append(np.diff(first) + 1)
    return np.concatenate(found), np.concatenate(sizes)


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, size, blob) of all documents, written once; chunks are numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, held[0].schema) as stream:
                for b in held:
                    stream.write_batch(b)
            blob = zstandard.ZstdCompressor(level=6).compress(out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([blob], pa.binary())], ["size", "blob"])

        for batch in words.bounded(batches, 1, chunk_bytes // 8):
            if not batch.num_rows:
                continue
            held.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).fill_null("")], ["doc_id", "text"]))
            size += held[-1].nbytes
            if size >= chunk_bytes:
                yield chunk()
                held, size = [], 0
        if held:
            yield chunk()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "size long, blob binary")
    held = cut(rows.select(F.monotonically_increasing_id().alias("mark"), "size", "blob"))
    part, place = F.shiftright("mark", 33), F.col("mark").bitwiseAND((1 << 33) - 1)
    most = held.agg(F.coalesce(F.max(place), F.lit(0))).first()[0]  # numbers without gaps of billions take fewer bytes
    return held.select((part * (most + 1) + place).alias("chunk"), "size", "blob")


def _each(make):
    """mapInArrow over chunks: rows (shard, chunk, blob) of what make gives for each, an iterator of (shard, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, chunk = batch.column("chunk")[k].as_py(), Chunk(batch.column("blob")[k].as_py())
                made = list(make(number, chunk))
                del chunk
                if made:
                    shard, blob = zip(*made)
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([number] * len(made), pa.int64()), pa.array(blob, pa.binary())], ["shard", "chunk", "blob"])

    return run


def _by_shard(n_shards: int, hashes: np.ndarray, numbers: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    bounds = np.searchsorted(shard_of(hashes, n_shards), np.arange(n_shards + 1)).tolist()
    for shard, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b > a:
            yield shard, pack(hashes[a:b], *(v[a:b] for v in numbers))


def _known(blobs: Iterable[bytes]) -> np.ndarray:
    """Sorted hashes of all messages to a shard."""
    parts, size, most = [np.zeros(0, np.uint64)], 0, 0

    def merged() -> np.ndarray:
        every = np.concatenate(parts)
        every.sort()
        return every[_changes(every)]

    for blob in blobs:
        parts.append(unpack(blob, 0)[0])
        size += len(parts[-1])
        if size > max(2 << 20, most):  # some messages at a time
            parts, size = [merged()], 0
            most = len(parts[0])
    return merged()


def _total(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place, exact beyond what a float holds."""
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, at, values)
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and more; 0.5, 1 and 1.5 where counts of counts are missing."""
    if not (n1 and n2):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(x, 0.0), float(k)) for k, x in enumerate(d)])


#: Of an order: how many n-grams there are, their counts in all, and how many have a count of one, two, three and four.
SUMMARY = "grams long, total long, n1 long, n2 long, n3 long, n4 long, tokens long, known long"


def _summary(value: np.ndarray, count: np.ndarray) -> pa.Table:
    kinds = [int(np.count_nonzero(value == k)) for k in (1, 2, 3, 4)]
    row = [int(np.count_nonzero(value)), int(value.sum()), *kinds, int(count.sum()), int(np.count_nonzero(count))]
    return pa.Table.from_arrays([pa.array([x], pa.int64()) for x in row], [c.split()[0] for c in SUMMARY.split(", ")])


def build(chunks: DataFrame, folder: str, order: int, n_shards: int) -> tuple[list[Answers], list[dict]]:
    """Stores what chunks are told; returns it by order, the first for single words, and the summary of each."""
    answers = [Answers(folder, n, n_shards, TOP if n == order else LOWER) for n in range(1, order + 1)]
    summaries: list[dict] = [{}] * order
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    for n in range(order, 0, -1):
        sent = chunks.select("chunk", "blob").mapInArrow(_each(_messages(n, n_shards, answers[n] if n < order else None)), BLOB)
        told = sent.groupBy("shard").applyInArrow(_stored(answers[n - 1]), SUMMARY)
        with brief_shuffles(chunks.sparkSession):
            row = told.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
        summaries[n - 1] = row.asDict()
    return answers, summaries


def _messages(n: int, n_shards: int, above: Answers | None):
    """What a chunk sends to the shards of order n; above tells of one word more, None for the highest order."""

    def counts(number: int, chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        grams = chunk.grams(n)
        return _by_shard(n_shards, grams.hash, [grams.count])

    def contexts(number: int, chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        longer = chunk.grams(n + 1)
        mine, value = above.read(number, len(longer.hash), 1)
        mine = (mine > 0) & (value > 0)
        place, value = longer.example(mine), value[mine]
        del longer, mine
        grams = chunk.grams(n)
        left, right, every = grams.at[place], grams.before[place], len(grams.hash)
        numbers = [np.bincount(left, minlength=every), _total(right, value, every)]
        numbers += [np.bincount(right[k], minlength=every) for k in (value == 1, value == 2, value > 2)]
        numbers.append(grams.count if n == 1 else np.zeros(every, np.int64))  # single words also carry how often they occur
        return _by_shard(n_shards, grams.hash, numbers)

    return counts if above is None else contexts


def _stored(own: Answers):
    fields = len(own.names)

    def store(rows: pa.Table) -> pa.Table:
        chunks, blobs = rows["chunk"].to_numpy(), rows["blob"]
        order = np.argsort(chunks, kind="stable")
        known = _known(blobs[k].as_py() for k in order.tolist())
        sums, owned, places = [np.zeros(len(known), np.int64) for _ in range(fields)], np.zeros(len(known), bool), []
        for k in order.tolist():
            hashes, *numbers = unpack(blobs[k].as_py(), fields)
            at = np.searchsorted(known, hashes)  # a chunk names an n-gram once
            for total, v in zip(sums, numbers):
                total[at] += v
            first = np.logical_or.reduce([v > 0 for v in numbers]) & ~owned[at]
            owned[at[first]] = True
            places.append((first, narrow(at)))
        del owned
        own.write(rows["shard"][0].as_py(), chunks[order], (pack_numbers([first, *(total[at] for total in sums)]) for first, at in places))
        return _summary(sums[0], sums[-1])

    return store


def probabilities(number: int, chunk: Chunk, answers: list[Answers], summaries: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its count in training, and its probability after the words before it, from single words up to the model's order."""
    p = count = np.ones(len(chunk.token))
    taken = [discounts(*(s[k] for k in ("n1", "n2", "n3", "n4"))) for s in summaries]
    for n, (told, s) in enumerate(zip(answers, summaries), 1):
        grams = chunk.grams(n)
        size, grams.hash = len(grams.hash), None
        _, value, *numbers = told.read(number, size)
        # What the n-gram's count gives, worked out once for each n-gram.
        kept = np.maximum(value - taken[n - 1][np.minimum(value, 3)], 0)[grams.at]
        if n == 1:
            count = numbers[-1][grams.at]
            if s["total"]:
                kinds = [s["n1"], s["n2"], s["grams"] - s["n1"] - s["n2"]]
                p = (kept + float(np.dot(taken[0][1:], kinds)) / (s["known"] + 1)) / s["total"]
        elif s["total"]:
            with np.errstate(divide="ignore", invalid="ignore"):
                kept += freed * p
                kept /= total
            p = np.where(total > 0, kept, p)
        if n < len(answers):  # of the words before each token: the sum of their followers' counts, and what is taken from these
            total, *kinds = numbers[:4]
            before, next_taken = grams.before, taken[n]
            freed = (next_taken[1] * kinds[0] + next_taken[2] * kinds[1] + next_taken[3] * kinds[2])[before]
            total = total[before]
            del before, kinds
        del grams, value, numbers, kept
    return count, p


def _score(answers: list[Answers], summaries: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = summaries[0]["tokens"], summaries[0]["known"]
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = Chunk(batch.column("blob")[k].as_py())
                count, p = probabilities(batch.column("chunk")[k].as_py(), chunk, answers, summaries)
                base = np.log10((count + 0.1) / (tokens + 0.1 * (known + 1)))
                logs = np.log10(p)
                total = lambda x, chunk=chunk: np.add.reduceat(x, chunk.start)
                columns = [
                    pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.n_tokens), pa.array(total((count > 0).astype(np.int64))),
                    pa.array(np.full(len(chunk.ids), tokens)), pa.array(total(base)), pa.array(total(logs)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return run


def score(docs: DataFrame, order: int = 3, chunk_bytes: int = 16 << 20, shard_bytes: int = 32 << 20) -> DataFrame:
    """Scores every row of docs (doc_id, text; other columns are ignored) under its training rows.

    Rows whose crc32(doc_id) mod 10 is 0 are held out. A null text is empty: one token, the end. A null id
    counts as the empty text and is held out. Repeated rows are scored, and counted, as often as they occur. A very long
    text is a chunk of its own. Without training rows every token has the probability 1. An empty table gives an empty
    result. order is 2 or more. A shard holds the n-grams of about shard_bytes of text. What chunks are told stays in
    the shared folder, in language-model-*.
    """
    if order < 2:
        raise ValueError("a Kneser-Ney model needs an order of 2 or more")
    spark = docs.sparkSession
    chunks = _chunks(docs, chunk_bytes)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    folder = f"{_posix(shared_folder(spark))}/language-model-{uuid.uuid4().hex}"
    answers, summaries = build(chunks, folder, order, max(1, -(-size // shard_bytes)))
    return chunks.select("chunk", "blob").mapInArrow(_score(answers, summaries), RESULT)
