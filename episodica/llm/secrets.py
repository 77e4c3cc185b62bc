"""Secret scans: patterns, and a convolutional network over every candidate in its context.

Patterns give the base findings. Candidates are these and all runs of at least eight key-like
characters; a byte network reads each with the text around it, long runs in windows that overlap,
of which the largest score counts. Base findings stay whatever it says of them; of the others those
above the threshold are added. The network is trained on labelled findings that a seeded generator
writes: keys of many formats where they occur in code and prose, next to words, paths, identifiers,
numbers and rules. The documents' own candidates have no labels, and keys may be among them, so only
those of a bounded sample that have the form of words, letters of one case and separators, join the
harmless ones. All go through the same search for candidates as documents do. Four parts keep
apart what must not be judged by itself: one is fitted, on the second a logistic function turns
outputs into probabilities, on the third the threshold is the highest that keeps the recall asked
for, and the fourth, by another generator, reports what that gives.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm import words
from episodica.llm.byte_cnn import WINDOW, Network
from episodica.llm.tables import fitted

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,probability:double>>"

_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_KEY = np.zeros(256, dtype=bool)
_KEY[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
BEFORE, MOST, SHORTEST = 40, 62, 8  # bytes of context before a candidate, of a candidate in one window, and of the shortest


def pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, start, end) of the windows' keys: a run of more than MOST bytes in steps of half of that, to its end."""
    n = np.maximum(1, -(-(end - start - MOST) // (MOST // 2)) + 1)
    of = np.repeat(np.arange(len(n)), n)
    at = np.minimum(start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * (MOST // 2), np.maximum(start[of], end[of] - MOST))
    return of, at, np.minimum(at + MOST, end[of])


def windows(data: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Each key between two marks, with the text before and after it inside data[low:high].

    Bytes of the key, which are ASCII, have their highest bit set, so the network tells them from the same bytes of the
    text around; there all bytes beyond ASCII are one.
    """
    column, size = np.arange(WINDOW)[None], (end - start)[:, None]
    place = start[:, None] - BEFORE + column
    place = np.where(column > BEFORE, place - 1, place)  # behind the first mark
    behind = column > BEFORE + 1 + size
    place = np.where(behind, place - 1, place)  # behind the second one
    out = np.where((place >= low[:, None]) & (place < high[:, None]), data[np.clip(place, 0, len(data) - 1)], np.uint8(0))
    out = np.where(out > 127, np.uint8(3), out)
    out = np.where((column > BEFORE) & (column <= BEFORE + size), out | np.uint8(128), out)
    out[:, BEFORE] = 1
    out[np.arange(len(out)), BEFORE + 1 + size[:, 0]] = 2
    return out


class Text:
    """A batch of texts, its key-like runs and its base findings, in bytes."""

    def __init__(self, column: pa.Array):
        texts = [t or "" for t in column.to_pylist()]
        self.data, self.offsets = words.text_buffer(column)
        lead = (self.data & 0xC0) != 0x80
        self.points = np.concatenate([[0], np.cumsum(lead)])  # code points before each byte
        byte_of = np.append(np.flatnonzero(lead), len(self.data))
        base = [(d, a, k, b) for d, t in enumerate(texts) for a, k, b in base_spans(t)]
        doc, a, kind, b = (np.array(c, dtype=np.int64) for c in zip(*base)) if base else [np.zeros(0, np.int64)] * 4
        shift = self.points[self.offsets[doc]]
        start, end = byte_of[shift + a], byte_of[shift + b]
        low, high, _ = words.spans(self.data, self.offsets, _HEX)
        long = high - low >= 24
        low, high = low[long], high[long]
        self.kind = np.concatenate([kind, np.full(len(low), 2)])
        self.start, self.end = np.concatenate([start, low]), np.concatenate([end, high])
        covered = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(covered, self.start, 1)
        np.add.at(covered, self.end, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
        low, high, _ = words.spans(self.data, self.offsets, _KEY)
        free = (high - low >= SHORTEST) & (covered[high] == covered[low])
        self.kind = np.concatenate([self.kind, np.full(free.sum(), 3)])
        self.start, self.end = np.concatenate([self.start, low[free]]), np.concatenate([self.end, high[free]])
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1

    def like_words(self) -> np.ndarray:
        """Which candidates have the form of words."""
        data = self.data.tobytes()
        return np.array([_WORDS.fullmatch(data, a, b) is not None for a, b in zip(self.start.tolist(), self.end.tolist())], dtype=bool)

    def asked(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(candidate of each window, windows), some thousand at a time."""
        of, start, end = pieces(self.start, self.end)
        for a in range(0, len(of), 16384):
            k = slice(a, a + 16384)
            doc = self.doc[of[k]]
            yield of[k], windows(self.data, self.offsets[doc], self.offsets[doc + 1], start[k], end[k])

    def spans(self, probability: np.ndarray, threshold: float) -> list[list[dict]]:
        """Of each text: all base findings and the other candidates at the threshold or above, by start, then kind."""
        out: list[list[dict]] = [[] for _ in range(len(self.offsets) - 1)]
        kept = np.flatnonzero((self.kind < 3) | (probability >= threshold))
        kept = kept[np.lexsort((self.kind[kept], self.start[kept]))]
        shift = self.points[self.offsets[self.doc[kept]]]
        columns = (self.doc[kept], self.kind[kept], self.points[self.start[kept]] - shift, self.points[self.end[kept]] - shift, probability[kept])
        for d, k, a, b, p in zip(*(c.tolist() for c in columns)):
            out[d].append({"kind": KINDS[k], "start": a, "end": b, "probability": p})
        return out


#: What has the form of words: letters in one case but for initials, between separators.
_WORDS = re.compile(rb"[-+/_=]*([A-Za-z]?[a-z]+|[A-Z]+)([-+/_=]+([A-Za-z]?[a-z]+|[A-Z]+))*[-+/_=]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the two word patterns find; runs of hex digits are found in bytes."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


#: Beginnings by which services mark their keys.
PREFIXES = ("ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "npm_", "AIza", "eyJ")
OTHER_PREFIXES = ("pk_test_", "dop_v1_", "hf_", "shpat_", "rk_live_", "ATATT3", "key-", "dapi")


class Writer:
    """Random texts with at most one key each; `text` gives the text, and where its key stands."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, chars: str, a: int, b: int | None = None) -> str:
        return "".join(self.r.choice(chars) for _ in range(self.r.randint(a, b or a)))

    def word(self, most: int = 4) -> str:
        vowels, others = "aeiouyäöüéèó" if self.r.random() < 0.2 else "aeiou", "bcdfghklmnprstvwz"
        return "".join(self.some(others, 1, 2) + self.some(vowels, 1, 2) for _ in range(self.r.randint(1, most))) + self.r.choice(["", "n", "s", "r", "t"])

    def prose(self, n: int) -> str:
        out = [self.r.choice([self.word(), self.word(), self.word(7), self.word().title(), self.harmless()]) for _ in range(n)]
        return " ".join(w + self.r.choice(["", "", "", ",", ".", ";", "\n", ":"]) for w in out)

    def mixed(self, a: int, b: int) -> str:
        return self.some(string.ascii_letters + string.digits, a, b)

    def secret(self) -> str:
        return self.r.choice((
            lambda: self.mixed(12, 19),
            lambda: self.mixed(20, 60),
            lambda: self.mixed(64, 120),
            lambda: self.some(string.ascii_letters + string.digits + "+/", 38, 62) + self.r.choice(["", "=", "=="]),
            lambda: self.r.choice(PREFIXES) + self.mixed(20, 40),
            lambda: self.some(string.digits + "ABCDEF", 24, 40),
            lambda: self.some(string.ascii_uppercase + string.digits, 16, 32),
            lambda: self.some(string.ascii_lowercase + string.digits, 16, 40),
            lambda: "-".join(self.mixed(6, 12) for _ in range(3)),
        ))()

    def harmless(self) -> str:
        d = string.digits
        return self.r.choice((
            lambda: "/".join(self.word() for _ in range(self.r.randint(2, 6))) + self.r.choice(["", "/" + self.some(d, 1, 4)]),
            lambda: "_".join(self.word() for _ in range(self.r.randint(2, 6))) + self.some(d, 1, 3),
            lambda: "-".join([*(self.word() for _ in range(self.r.randint(2, 5))), self.some(d, 1, 4)]),
            lambda: self.word() + "".join(self.word().title() for _ in range(self.r.randint(1, 5))),
            lambda: "".join(self.word().title() for _ in range(self.r.randint(2, 5))) + self.some(d, 1, 3),
            lambda: f"20{self.some(d, 2)}-{self.some(d, 2)}-{self.some(d, 2)}" + self.r.choice(["", f"-{self.word()}-v{self.some(d, 1, 2)}"]),
            lambda: self.some(d, 8, 20),
            lambda: self.some(d, 4) + "-" + self.some(d, 4) + "-" + self.some(d, 4),
            lambda: self.r.choice("=-_+/") * self.r.randint(8, 60),
            lambda: self.word(8) + self.word(5),
            lambda: self.word(5).upper(),
            lambda: self.word() + "=" + self.word() + self.some(d, 0, 3),
            lambda: self.some(self.r.choice(string.ascii_lowercase), 8, 40),
        ))()

    AROUND = (" ", "key = ", 'KEY: "', "Authorization: Bearer ", "export AUTH=", "credentials ", "see ", "in ", "id=", "file ", "--", "(", "use ", "\n")

    def text(self, with_key: bool) -> tuple[str, int, int]:
        key = self.secret() if with_key else ""
        lead = self.r.choice(self.AROUND[1:6] if with_key and self.r.random() < 0.6 else self.AROUND)
        head = self.prose(self.r.randint(1, 10)) + " " + lead
        return head + key + self.r.choice(['"', " ", "\n", ",", ")", ""]) + " " + self.prose(4), len(head), len(head) + len(key)


class OtherWriter(Writer):
    """Other formats, words and surroundings than those that the network is fitted to."""

    def word(self, most: int = 4) -> str:
        parts = ("ing", "tion", "schaft", "lich", "mente", "ado", "eur", "ance", "ver", "pro", "kon", "dis", "str", "al", "um", "or")
        return "".join(self.r.choice(parts) for _ in range(self.r.randint(1, max(2, most))))

    def secret(self) -> str:
        return self.r.choice((
            lambda: self.r.choice(OTHER_PREFIXES) + self.mixed(24, 44),
            lambda: self.mixed(14, 48),
            lambda: self.some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24, 56),
            lambda: self.some(string.ascii_letters + string.digits + "-_", 30, 90),
            lambda: self.some(string.ascii_letters + string.digits + "/+", 40) + "=",
        ))()

    def harmless(self) -> str:
        d = string.digits
        return self.r.choice((
            lambda: "get" + self.word().title() + "By" + self.word().title(),
            lambda: "usr/share/" + self.word() + "/" + self.word() + "-" + self.some(d, 1, 2),
            lambda: self.word() + "__" + self.word() + "--" + self.word(),
            lambda: self.some(d, 3) + "-" + self.some(d, 1) + "-" + self.some(d, 5) + "-" + self.some(d, 3) + "-" + self.some(d, 1),
            lambda: "MAX_" + self.word().upper() + "_" + self.some(d, 1, 2),
            lambda: self.word(9),
            lambda: self.some(d, 9, 16),
            lambda: "=" * self.r.randint(8, 70),
            lambda: self.word() + "+" + self.word() + "/" + self.word(),
        ))()

    AROUND = (" ", "curl -H 'X-Auth: ", "- name: ", "INSERT VALUES ('", "login with ", "value ", "[", "got ", "\t", "commit ")


def labelled(writer: Writer, n: int) -> tuple[Text, np.ndarray, int]:
    """Candidates of n generated texts, which of them are keys, and how many keys the texts hold."""
    made = [writer.text(k % 2 == 0) for k in range(n)]
    text = Text(pa.array([t for t, *_ in made]))
    low, high = (np.array([m[c] for m in made])[text.doc] for c in (1, 2))
    shift = text.points[text.offsets[text.doc]]
    start, end = text.points[text.start] - shift, text.points[text.end] - shift
    inside = np.minimum(high, end) - np.maximum(low, start)
    return text, 2 * inside > np.maximum(end - start, high - low), -(-n // 2)


class Judge:
    """recall, precision and false_rate are those of the other generator's texts, keys that the search misses included.

    sample: texts whose word-like candidates count as harmless; nothing else is known of them.
    """

    def __init__(self, recall: float = 0.95, sample: pa.Array | None = None, seed: int = 5, n: int = 2000):
        text, truth, _ = labelled(Writer(seed), n)
        x, y, r = [], [], np.random.default_rng(seed)
        own = Text(sample if sample is not None else pa.array([], pa.string()))
        for held, right, share in ((text, truth, 4.0), (own, np.zeros(len(own.start), dtype=bool), 6.0)):
            free = held.kind == 3
            if held is own:
                free &= own.like_words()
            chosen = free & (r.random(len(right)) < np.where(right, 1.0, min(1.0, share * n / 2 / max(1, (free & ~right).sum()))))
            for of, window in held.asked():
                x.append(window[chosen[of]])
                y.append(right[of][chosen[of]])
        self.network = Network(["harmless", "secret"]).fit(np.concatenate(x), np.concatenate(y).astype(np.int64), epochs=5)
        self.network.fold()
        self.scale = np.array([0.0, 1.0])
        text, truth, _ = labelled(Writer(seed + 1), n)
        z = self.margins(text)
        for _ in range(30):  # Newton steps of the calibration
            p = 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * z, -30, 30)))
            design = np.stack([np.ones_like(z), z], 1)
            curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            self.scale = self.scale + np.clip(np.linalg.solve(curve, design.T @ (truth - p) - 1e-3 * self.scale), -1, 1)
        text, truth, keys = labelled(Writer(seed + 2), n)
        right = np.sort(self.probabilities(text)[truth])[::-1]
        #: The least score among the best `recall` of all keys; keys that the search does not offer count as missed.
        self.threshold = float(right[min(len(right), int(np.ceil(recall * keys))) - 1])
        text, truth, keys = labelled(OtherWriter(seed + 3), n)
        said = self.probabilities(text) >= self.threshold
        self.recall, self.precision = float((said & truth).sum() / keys), float(truth[said].mean())
        self.false_rate = float(said[~truth].mean())

    def margins(self, text: Text) -> np.ndarray:
        """Of each candidate: the largest difference of its windows' two outputs."""
        out = np.full(len(text.start), -np.inf)
        for of, window in text.asked():
            z = self.network.logits(window).astype(np.float64)
            np.maximum.at(out, of, z[:, 1] - z[:, 0])
        return out

    def probabilities(self, text: Text) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * self.margins(text), -30, 30)))


def judged(recall: float, sample: pa.Array | None, least: float = 0.9) -> Judge:
    """A judge that finds at least the share `least` of the other generator's keys: with the sample's words as harmless, or
    if these take too much away, without them; an error if that is not enough either."""
    judge = Judge(recall, sample)
    if judge.recall < least and sample is not None:
        judge = Judge(recall)
    if judge.recall < least:
        raise ValueError(f"the network finds {judge.recall:.3f} of the keys of another generator, less than {least}")
    return judge


def _scan(judge: Judge) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in words.bounded(batches, 1):
            text = Text(batch.column(1))
            spans = text.spans(judge.probabilities(text), judge.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, recall: float = 0.95, most: int = 500, longest: int = 20_000) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, probability; by start, then kind) of every row of docs.

    Only doc_id and text are read; a null text counts as empty and has no spans. Spans of different pattern kinds may
    overlap; learned ones overlap none. The probability is the network's for base spans too. A candidate whose
    probability equals the threshold is added. Texts are scanned whole, and runs of any length. Repeated rows are
    scanned each. An empty table gives an empty result. The fit takes as harmless what word-like candidates stand in the
    `most` texts of at most `longest` characters that come first by their hash, and is refused if it finds less than 0.9
    of the keys of another generator's texts.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    short = rows.where(F.length("text") <= longest).select(F.xxhash64("text").alias("hash"), "text")
    judge = fitted(short.orderBy("hash").limit(most), lambda sample: judged(recall, sample["text"].unique().sort()))
    held = docs.sparkSession.sparkContext.broadcast(judge or judged(recall, None))
    return rows.mapInArrow(lambda batches: _scan(held.value)(batches), FOUND)
