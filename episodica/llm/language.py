"""Language identification: a convolutional network over bytes, trained and applied in numpy.

Windows of a fixed number of bytes go through an embedding, filters of several widths, a
rectifier, max pooling over the window and a softmax. A document is the mean of its windows'
scores, weighted by their letters. In use, embedding and filters are folded into tables: what a
pair of bytes adds to each filter is looked up, a position of thousands of windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm import words
from episodica.llm.byte_cnn import WINDOW, Network
from episodica.llm.tables import fitted, id_remainder

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window x byte, document of each window): whole texts in consecutive windows, the last filled up with zeros."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start]
    return np.where(np.arange(WINDOW) < (offsets[doc + 1] - start)[:, None], out, np.uint8(0)), doc


def train(docs: DataFrame, per_label: int = 600, most: int = 120_000) -> Network | None:
    """Fits on windows of about per_label different texts of each label, drawn by hash from the learnable rows.

    A drawn text gives four windows at most, so the task that fits gets about 4 * per_label windows of a label, and of all labels
    together about 4 * most: where there are more than most / per_label labels, each gives fewer texts, but the one with
    the least hash always. Equal texts are drawn together and used once. None where nothing is labelled.
    """
    learn = docs.where(id_remainder(docs["doc_id"], 4) != 2).where(docs["lang"].isNotNull() & docs["text"].isNotNull())
    learn = learn.select("lang", "text", F.xxhash64("text").alias("hash"))
    counts = learn.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts"), F.min("hash").alias("least")).collect()
    if not counts:
        return None
    wanted = min(per_label, max(1, most // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, wanted / max(1, r["texts"])))))
    draw = F.pmod(F.xxhash64("hash"), F.lit(1 << 40)) / (1 << 40)  # of a hash again: the windows are drawn by the hash of places
    least = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], r["least"])))  # of a label whose draw may be empty
    drawn = learn.where((draw < share[F.col("lang")]) | (F.col("hash") == least[F.col("lang")])).groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 1):
            x, doc = windows(*words.text_buffer(pc.utf8_lower(batch.column(1))))
            within = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.uint64)
            rank = np.lexsort((words.mix(within + np.uint64(1)), doc))
            place = np.empty(len(doc), dtype=np.int64)
            place[rank] = np.arange(len(doc)) - np.searchsorted(doc, doc)
            keep = np.flatnonzero(place < 4)
            lang = batch.column(0).take(pa.array(doc[keep]))
            yield pa.RecordBatch.from_arrays([lang, pa.array([x[k].tobytes() for k in keep], pa.binary())], ["lang", "window"])

    def fit(sample: pa.Table) -> Network:
        taken = sorted(zip(sample["lang"].to_pylist(), sample["window"].to_pylist()))
        labels = sorted({lang for lang, _ in taken})
        x = np.frombuffer(b"".join(w for _, w in taken), np.uint8).reshape(-1, WINDOW)
        return Network(labels).fit(x, np.searchsorted(np.array(labels), [lang for lang, _ in taken]))

    return fitted(drawn.mapInArrow(cut_windows, "lang string, window binary"), fit)


def _predict(network: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 2):
            texts = batch.column(2).to_pylist()
            spoken = np.array([bool(_LETTER.search(t or "")) for t in texts], dtype=bool)
            if network is None or not len(texts):
                best, score, spoken = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
                labels = ["und"]
            else:
                x, doc = windows(*words.text_buffer(pc.utf8_lower(batch.column(2))))
                letters = words.LETTERS[x].sum(1) + 1e-3
                weight = np.bincount(doc, weights=letters, minlength=len(texts))
                raw = network.logits(x)
                z = np.stack([np.bincount(doc, weights=letters * raw[:, k], minlength=len(texts)) for k in range(raw.shape[1])], 1)
                z = z / np.maximum(weight, 1e-9)[:, None]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best, score, labels = p.argmax(1), p.max(1), network.labels
            named = [labels[k] if ok else "und" for k, ok in zip(best, spoken)]
            out = [batch.column(0), batch.column(1), pa.array(named, pa.string()), pa.array(np.where(spoken, score, 0.0))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, per_label: int = 600) -> DataFrame:
    """Predicts a language for every row of docs from its whole text.

    Learns from text and non-null lang of rows whose crc32(doc_id) mod 4 is not 2; other columns are not read. Null
    texts, texts without a letter, and all texts where nothing is labelled, give `und` with score 0. A very long text is
    read whole, window by window. Of languages of equal score the first by name is given. Repeated rows are predicted
    each. An empty table gives an empty result.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    network = train(rows, per_label)
    if network is not None:
        network.fold()
    held = docs.sparkSession.sparkContext.broadcast(network)
    asked = rows.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return asked.mapInArrow(lambda batches: _predict(held.value)(batches), PREDICTED)
