"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals add up to document scores.

Only documents carry labels, so the labels of words are inferred first: words and word beginnings
that are much more frequent in toxic documents than in clean ones, and stand in many different
places (those of a copied document do not), mark toxic words there. The field learns from these
tags; its features are the word, its beginnings (so inflected forms count together) and its two
neighbours, and it is fitted by the likelihood of whole chains: expected counts from forward and backward passes
against the tags' own. A chain is a whole document. The passes run over blocks of words side by side: the product
of a block's transfer matrices tells what enters the next one, so no chain is cut. A logistic function of the largest
marginal and of their sum, fitted to the document labels, is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm import words
from episodica.llm.tables import fitted, id_remainder

BLOCK, BEGINNINGS = 64, (4, 5, 6)  # words that a pass takes side by side, bytes of a word's beginnings
SCORED = (
    "doc_id long, held_out boolean, score double, predicted int, "
    "spans array<struct<start:long,end:long,probability:double>>"
)


class Words:
    """Lower-case runs of letters of some texts; the words of a text are one chain."""

    def __init__(self, column: pa.Array):
        data, self.offsets = words.text_buffer(column)
        self.data = words.ASCII_LOWER[data]
        self.starts, self.ends, self.first = words.spans(self.data, self.offsets, words.LETTERS)
        size = self.ends - self.starts
        self.kinds = [words.hashes(self.data, self.starts, self.ends)]  # hashes of the word and of its beginnings
        for n in BEGINNINGS:
            long = np.flatnonzero(size >= n)
            h = np.zeros(len(size), np.uint64)
            h[long] = words.hashes(self.data, self.starts[long], self.starts[long] + n)
            self.kinds.append(h)
        self.heads = self.first[:-1][np.diff(self.first) > 0]
        self.tails = self.first[1:][np.diff(self.first) > 0] - 1


class Field:
    """Two states, 0 for other words and 1 for toxic ones; only differences of scores matter."""

    def __init__(self, known: list[np.ndarray]):
        #: Sorted hashes of words, beginnings and neighbours that have weights; all others have none.
        self.known = known
        self.filters = []
        for h in known:
            self.filters.append(np.zeros(1 << 16, dtype=bool))
            self.filters[-1][(h & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.weights = [np.zeros(len(known[k]) + 1) for k in (0, 1, 2, 3, 4, 4)]  # for state 1
        self.transition = np.zeros((2, 2))
        self.bias = np.full(1, -3.0)

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        maybe = np.flatnonzero(self.filters[k][(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.known[k], h[maybe])
        at[at == len(self.known[k])] = 0
        ok = self.known[k][at] == h[maybe] if len(self.known[k]) else np.zeros(0, dtype=bool)
        out[maybe[ok]] = at[ok] + 1
        return out

    def features(self, w: Words) -> list[np.ndarray]:
        own = [self.find(k, h) for k, h in enumerate(w.kinds)]
        near = self.find(4, w.kinds[0])
        before, after = np.roll(near, 1), np.roll(near, -1)
        before[w.heads], after[w.tails] = 0, 0
        return [*own, before, after]

    def emission(self, features: list[np.ndarray]) -> np.ndarray:
        return self.bias[0] + sum(v[f] for v, f in zip(self.weights, features))

    def marginals(self, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state 1) of every word, and the expected number of each pair of states that follow each other.

        Chain k is score[first[k] : first[k + 1]]. States of a word are kept as the share of state 1, which is all that
        matters of a message.
        """
        out, pairs = np.zeros(len(score)), np.zeros((2, 2))
        if not len(score):
            return out, pairs
        (t00, t01), (t10, t11) = np.exp(self.transition)
        blocks = -(-np.diff(first) // BLOCK)
        chain = np.repeat(np.arange(len(blocks)), blocks)
        place = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[chain] + place * BLOCK
        size = np.minimum(BLOCK, first[chain + 1] - begin)
        by_size = np.argsort(-size, kind="stable")
        chain, place, begin, size = chain[by_size], place[by_size], begin[by_size], size[by_size]
        starts = place == 0
        alive = [int(np.searchsorted(-size, -i, side="left")) for i in range(int(size[0]))]  # blocks longer than i come first
        odds = [np.exp(np.clip(score[begin[:k] + i], -30, 30)) for i, k in enumerate(alive)]
        # Products of transfer matrices: rows of a block's matrix, in common scale.
        m = np.zeros((4, len(begin)))
        m[0], m[3] = 1.0, 1.0
        for i, k in enumerate(alive):
            a, b, c, d = m[:, :k]
            new = np.stack([a * t00 + b * t10, (a * t01 + b * t11) * odds[i], c * t00 + d * t10, (c * t01 + d * t11) * odds[i]])
            if i == 0:
                new = np.where(starts[:k], np.stack([np.ones(k), np.zeros(k), np.zeros(k), odds[0]]), new)
            m[:, :k] = new / new.sum(0)
        enters, leaves = np.full(len(begin), 0.5), np.full(len(begin), 0.5)
        at = np.empty(len(begin), dtype=np.int64)
        at[np.lexsort((place, chain))] = np.arange(len(begin))  # of a block in the order of chains and places
        back = np.argsort(at)
        ahead = _levels(place)
        for now in ahead[:-1]:
            now = now[place[now] + 1 < blocks[chain[now]]]
            p, (a, b, c, d) = enters[now], m[:, now]
            one, zero = (1 - p) * b + p * d, (1 - p) * a + p * c
            enters[back[at[now] + 1]] = one / (one + zero)
        for now in ahead[:0:-1]:
            q, (a, b, c, d) = leaves[now], m[:, now]
            up, down = c * (1 - q) + d * q, a * (1 - q) + b * q
            leaves[back[at[now] - 1]] = up / (up + down)
        forward = []
        for i, k in enumerate(alive):
            p = forward[-1][:k] if i else enters
            one, zero = odds[i] * ((1 - p) * t01 + p * t11), (1 - p) * t00 + p * t10
            if i == 0:
                one, zero = np.where(starts, odds[0], one), np.where(starts, 1.0, zero)
            forward.append(one / (one + zero))
        q = np.zeros(0)
        for i in range(len(alive) - 1, -1, -1):
            k = alive[i]
            q = np.concatenate([q, leaves[len(q) : k]])  # blocks that end here
            p = forward[i] * q
            out[begin[:k] + i] = p / (p + (1 - forward[i]) * (1 - q))
            one, zero = odds[i] * q, 1 - q
            before = forward[i - 1][:k] if i else enters
            x = np.stack([(1 - before) * t00 * zero, (1 - before) * t01 * one, before * t10 * zero, before * t11 * one])
            x = x / x.sum(0)
            pairs += (x if i else x[:, ~starts]).sum(1).reshape(2, 2)
            up, down = t11 * one + t10 * zero, t01 * one + t00 * zero
            q = up / (up + down)
        return out, pairs

    def fit(self, w: Words, tags: np.ndarray, epochs: int = 60, rate: float = 0.2, decay: float = 1e-4) -> Field:
        """Full-batch Adam on the likelihood of the tags of whole chains."""
        n, features = len(tags), self.features(w)
        inside = np.ones(n, dtype=bool)
        inside[w.heads] = False
        follow = np.flatnonzero(inside)
        seen = np.bincount(2 * tags[follow - 1].astype(np.int64) + tags[follow], minlength=4).reshape(2, 2)
        some = [np.flatnonzero(f) for f in features]  # most words have no feature at all
        values = [*self.weights, self.transition, self.bias]
        mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for step in range(1, epochs + 1):
            p, pairs = self.marginals(self.emission(features), w.first)
            error = (p - tags) / n
            d_weights = [np.bincount(f[k], weights=error[k], minlength=len(v)) + decay * v / n for f, k, v in zip(features, some, self.weights)]
            gradients = [*d_weights, (pairs - seen) / n, np.array([error.sum()])]
            for v, m, s, g in zip(values, mean, square, gradients):
                m += 0.1 * (g - m)
                s += 0.01 * (g**2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
            for v in self.weights:
                v[0] = 0.0  # a word without a feature
        return self


def _levels(place: np.ndarray) -> list[np.ndarray]:
    """The blocks of each place, for all places."""
    order = np.argsort(place, kind="stable")
    return np.split(order, np.cumsum(np.bincount(place))[:-1])


def infer_tags(w: Words, toxic: np.ndarray, least: float = 0.02, ratio: float = 20.0) -> np.ndarray:
    """1 for words of toxic documents that have a telling word or beginning.

    Telling is what at least the share `least` of the toxic documents has, in as many different surroundings as half of
    these documents, and is `ratio` times as frequent there as in clean documents.
    """
    n = len(toxic)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(w.first))
    there, clean = np.flatnonzero(toxic[doc]), np.flatnonzero(~toxic[doc])
    around = words.pair(np.roll(w.kinds[0], 1), np.roll(w.kinds[0], -1))[there]
    tags = np.zeros(len(doc), np.int8)
    for h in w.kinds:
        known, code = np.unique(h[there], return_inverse=True)
        bad = np.bincount(np.unique(code * n + doc[there]) // n, minlength=len(known))
        _, pick = np.unique(words.pair(h[there], around), return_index=True)
        places = np.bincount(code[pick], minlength=len(known))
        marked = (bad >= max(4, least * toxic.sum())) & (places >= 0.5 * bad) & (known > 0)
        known, bad = known[marked], bad[marked]
        if not len(known):
            continue
        code = np.minimum(np.searchsorted(known, h[clean]), len(known) - 1)
        same = known[code] == h[clean]
        good = np.bincount(np.unique(code[same] * n + doc[clean[same]]) // n, minlength=len(known))
        lift = ((bad + 0.5) / (toxic.sum() + 1)) / ((good + 0.5) / ((~toxic).sum() + 1))
        tags[there[np.isin(h[there], known[lift >= ratio])]] = 1
    return tags


def telling(w: Words, tags: np.ndarray, least: int = 4) -> list[np.ndarray]:
    """The words, beginnings and neighbours that stand with at least `least` tagged words."""
    tagged = np.flatnonzero(tags)
    before, after = np.roll(w.kinds[0], 1), np.roll(w.kinds[0], -1)
    groups = [*(h[tagged] for h in w.kinds), np.concatenate([before[tagged], after[tagged]])]
    out = []
    for h in groups:
        known, count = np.unique(h, return_counts=True)
        out.append(known[(count >= least) & (known > 0)])
    return out


class Model:
    def __init__(self, field: Field, logistic: np.ndarray):
        self.field, self.logistic = field, logistic

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(1, logit of the largest marginal, log of their sum) of each document, and all marginals."""
        p, _ = self.field.marginals(self.field.emission(self.field.features(w)), w.first)
        n = len(w.first) - 1
        total = np.bincount(np.repeat(np.arange(n), np.diff(w.first)), weights=p, minlength=n)
        most = np.zeros(n)
        full = np.flatnonzero(np.diff(w.first))
        if len(full):
            most[full] = np.maximum.reduceat(p, w.first[full])
        most = np.clip(most, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(n), np.log(most / (1 - most)), np.log1p(total)], 1), p

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.logistic, -30, 30)))


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """weight: how many labelled documents each sampled one stands for."""
    w = Words(pa.array(texts, pa.string()))
    tags = infer_tags(w, toxic)
    model = Model(Field(telling(w, tags)), np.zeros(3))
    if len(tags):
        model.field.fit(w, tags)
    x, _ = model.inputs(w)
    for _ in range(50):  # Newton steps; a small penalty keeps them finite where the classes come apart
        p = model.score(x)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1])
        step = np.linalg.solve(curve, x.T @ (weight * (toxic - p)) - np.array([0, 0.1, 0.1]) * model.logistic)
        model.logistic = model.logistic + np.clip(step, -1, 1)
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 20_000) -> Model | None:
    """Fits on about per_class documents of each class, drawn by hash among learnable rows of at most `longest` characters.

    Both bounds keep the task that fits small: at most 2 * per_class texts of a class, however many rows share an id.
    Longer texts are left out of the fit alone; all are scored whole. Equal texts are drawn once. None where a class is
    missing.
    """
    truth = labels.where(labels["toxic"].isin(0, 1)).groupBy(labels["doc_id"].cast("long").alias("of")).agg(F.max("toxic").alias("toxic"))
    truth = truth.where(id_remainder("of", 3) != 1)
    counts = {r["toxic"]: r["count"] for r in truth.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return None
    draw = F.pmod(F.xxhash64("of"), F.lit(1 << 20)) / (1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    drawn = truth.where(draw < share)
    rows = docs.join(F.broadcast(drawn), docs["doc_id"] == drawn["of"]).where(F.length("text") <= longest)
    texts = rows.groupBy("toxic", F.xxhash64("text", "toxic").alias("hash")).agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("hash"))  # a hard bound, where many rows share a drawn id
    texts = texts.withColumn("place", place).where(F.col("place") <= 2 * per_class)

    def fit(sample: pa.Table) -> Model | None:
        sample = sample.sort_by([("toxic", "ascending"), ("hash", "ascending")])
        toxic = sample["toxic"].to_numpy() == 1
        if not toxic.any() or toxic.all():
            return None
        weight = np.where(toxic, counts[1] / toxic.sum(), counts[0] / (~toxic).sum())
        return train(sample["text"].to_pylist(), toxic, weight)

    return fitted(texts.select("text", "toxic", "hash"), fit)


def _score(model: Model | None, cut: float, mark: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 2):
            n = batch.num_rows
            w = Words(batch.column(2))
            score, marks = np.zeros(n), [[] for _ in range(n)]
            if model is not None and n:
                x, p = model.inputs(w)
                score = model.score(x)
                hit = np.flatnonzero(p >= mark)
                before = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte
                doc = np.searchsorted(w.first, hit, side="right") - 1
                start, end = before[w.starts[hit]] - before[w.offsets[doc]], before[w.ends[hit]] - before[w.offsets[doc]]
                for d, a, b, q in zip(doc.tolist(), start.tolist(), end.tolist(), p[hit].tolist()):
                    marks[d].append({"start": a, "end": b, "probability": q})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            out = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32)), pa.array(marks, kind)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted", "spans"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, mark: float = 0.5, per_class: int = 2000) -> DataFrame:
    """Scores every row of docs from its whole text; spans are the words (in code points) with a marginal of `mark` or more.

    Learns from labels of ids whose crc32 mod 3 is not 1; of several labels of an id the largest holds. Of docs only
    doc_id and text are read. Null and empty texts get the score of a text without toxic words. Without labels of
    both classes every score is 0. A very long text is one chain. A score equal to cut counts as toxic. Repeated rows are
    scored each. An empty table gives an empty result.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    model = learn(rows, labels, per_class)
    held = docs.sparkSession.sparkContext.broadcast(model)
    asked = rows.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return asked.mapInArrow(lambda batches: _score(held.value, cut, mark)(batches), SCORED)


def harmless(docs: DataFrame, labels: DataFrame, cut: float = 0.7, per_class: int = 2000) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below cut. Rows move between no tasks.

    Null and empty texts have the score of a text without toxic words, and repeated rows one score. Without labels of both
    classes all rows stay. Columns may have any names. An empty table gives an empty result.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(learn(rows, labels, per_class))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, "text"):
            if held.value is not None and batch.num_rows:
                score = held.value.score(held.value.inputs(Words(batch.column("text")))[0])
                batch = batch.filter(pa.array(score < cut))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
