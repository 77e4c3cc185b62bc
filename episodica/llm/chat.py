"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once; the byte spans of its tokens are then
intersected with the sorted spans of its turns by binary search. The marks of the template are
added tokens of their own, which part the text before words are formed, so the edges of every
turn's text are edges of tokens and no token holds both text and template. Control strings inside
roles and texts are escaped: a backslash goes after their first character, and where backslashes
stand there already, one more; so no text can open or close a turn, and unescaping gives every
text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.tables import shards
from episodica.llm.tokens import encoding, vocabulary_path

OPEN, BODY, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings by which this and other common templates mark turns.
CONTROLS = (OPEN, BODY, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_RAW = re.compile("|".join(rf"({re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"({re.escape(c[0])})(\\*)\\(?={re.escape(c[1:])})" for c in CONTROLS))
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(BODY) + r"(.*?)" + re.escape(CLOSE), re.DOTALL)
FORMATTED = (
    "conv_id long, n_turns long, formatted string, token_ids array<int>, loss_mask array<boolean>, "
    "loss_spans array<struct<start:long,end:long>>"
)


def escape(text: str) -> str:
    return _RAW.sub(lambda m: m.group() + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group()[:-1], text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The conversation, and where in it the text of each turn stands."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{BODY}", escape(text)
        parts += [head, body, CLOSE]
        spans.append((at + len(head), at + len(head) + len(body), role))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a rendered conversation")
    return turns


class Template:
    """The vocabulary with the template's marks as added tokens, and the bytes of every id."""

    def __init__(self, path: str):
        base = encoding(path)
        known = [base.decode_single_token_bytes(i) for i in range(base.n_vocab)]
        added = {mark: len(known) + k for k, mark in enumerate((OPEN, BODY, CLOSE))}
        self.bytes = [*known, *(mark.encode() for mark in added)]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.marks = set(added)
        ranks = {b: i for i, b in enumerate(known) if b.decode(errors="replace") not in base.special_tokens_set}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, formatted: str, spans: list[tuple[int, int, str]], role: str):
        """Token ids, which of them hold text of the role, and the spans (code points) of that text."""
        ids = np.array(self.encoding.encode(formatted, allowed_special=self.marks, disallowed_special=()), dtype=np.int32)
        ends = np.cumsum(self.sizes[ids])
        mine = [(a, b) for a, b, who in spans if who == role and a < b]
        mask = np.zeros(len(ids), dtype=bool)
        if mine:
            edges = np.array(mine)
            if not formatted.isascii():
                raw = np.frombuffer(formatted.encode(), np.uint8)
                edges = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[edges]  # bytes before code points
            begins = ends - self.sizes[ids]
            first = np.searchsorted(ends, edges[:, 0], side="right")
            last = np.searchsorted(begins, edges[:, 1], side="left")
            change = np.bincount(first, minlength=len(ids) + 1) - np.bincount(last, minlength=len(ids) + 1)
            mask = np.cumsum(change)[:-1] > 0
        return ids, mask, mine

    def masked_texts(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The unescaped text of each run of masked tokens, in order."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        return [unescape(b"".join([self.bytes[i] for i in ids[a:b].tolist()]).decode()) for a, b in zip(edge[::2], edge[1::2])]


@lru_cache(maxsize=2)
def template(path: str) -> Template:
    return Template(path)


def format_conversations(turns: DataFrame, role: str = "assistant", path: str | None = None) -> DataFrame:
    """A row per conv_id: the rendered conversation, its tokens, their loss mask, and the masked spans in code points.

    Rows are put in order of turn, then of role and text; only these columns and conv_id are read. Null roles and texts
    are empty, a null turn comes first, and rows with a null conv_id form one conversation. Repeated rows are
    repeated turns. An empty table gives an empty result. A task holds one conversation at a time, so very long texts are
    bounded by one conversation; a conversation is one row and so has to fit into a task.
    """
    path = path or vocabulary_path()

    def conversations(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        ids, n, formatted, tokens, masks, spans = zip(*out)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(formatted, pa.string()), lists(tokens, pa.int32()), lists(masks, pa.bool_()), pa.array(spans, kind)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "formatted", "token_ids", "loss_mask", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = template(path), [], 0
        for conv_id, rows in groupby(conversations(batches), key=lambda r: r[0]):
            said = [(r[2] or "", r[3] or "") for r in rows]
            formatted, spans = render(said)
            ids, mask, mine = held.encode(formatted, spans, role)
            out.append((conv_id, len(said), formatted, ids, mask, [{"start": a, "end": b} for a, b in mine]))
            size += len(formatted)
            if size > 4 << 20:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), turns["role"].alias("role"), turns["text"].alias("text")
    )
    dealt = rows.repartition(shards(turns.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).mapInArrow(run, FORMATTED)
