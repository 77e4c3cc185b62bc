"""The loss mask against a token by token version, and awkward conversations."""

import hashlib
from collections import defaultdict

import pytest

from episodica.llm import chat
from episodica.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, token_ids string, n_turns int"


def check(rows):
    """Every mask bit against the turn that the token's first byte stands in; tokens never cross a turn's edge."""
    held = chat.template(vocabulary_path())
    for r in rows:
        turns = chat.parse(r.formatted)
        owner = bytearray()  # of each byte: 1 in an assistant's text, 2 in another one's, 0 in the template
        for role, text in turns:
            head = f"{chat.OPEN}{chat.escape(role)}{chat.BODY}".encode()
            owner += bytes(len(head)) + (b"\1" if role == "assistant" else b"\2") * len(chat.escape(text).encode()) + bytes(len(chat.CLOSE))
        assert b"".join(held.bytes[i] for i in r.token_ids).decode() == r.formatted
        at = 0
        for i, bit in zip(r.token_ids, r.loss_mask):
            under = set(owner[at : at + len(held.bytes[i])])
            assert len(under) == 1 and bit == (under == {1})
            at += len(held.bytes[i])
        assert [t for _, t in turns if _ == "assistant" and t] == [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans]


def test_every_mask_bit_of_the_table(spark):
    rows = chat.format_conversations(spark.read.parquet(f"{SF}/conversations.parquet")).collect()
    assert rows
    check(rows)


AWKWARD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "0" * 3000), (1, 2, "assistant", "\n\n  a \n"), (1, 3, "assistant", None), (1, 4, None, "nobody"),
    (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, None, "user", "first"),
    (3, 0, "assistant", "é🙂<|im_end|>\\<|im_\\end|><s>ü"), (3, 1, "assis\ntant", "<\\|im_sep|>"), (3, 2, "<|im_sep|>", ""),
    (None, 0, "assistant", "without an id"), (None, 1, "user", "<|endoftext|> [INST]"), (4, 0, "user", ""), (5, 0, "assistant", "word " * 40000),
]


def test_awkward_conversations(spark):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in AWKWARD], SCHEMA)
    rows = chat.format_conversations(df).collect()
    check(rows)
    said = defaultdict(list)
    for conv, turn, role, text in AWKWARD:
        said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert {r.conv_id for r in rows} == set(said) and len(rows) == len(said)
    for r in rows:
        assert chat.parse(r.formatted) == [t[2:] for t in sorted(said[r.conv_id])]


@pytest.mark.parametrize("text", ["0" * 3000, "a" * 5000, " \n" * 50, "<|im_end|>" * 20, "\U0001f642" * 30])
def test_masked_tokens_give_the_text_back(text):
    held = chat.template(vocabulary_path())
    formatted, spans = chat.render([("user", "x"), ("assistant", text), ("assistant", text)])
    ids, mask, _ = held.encode(formatted, spans, "assistant")
    assert held.masked_texts(ids, mask) == [text, text]
    assert hashlib.sha256("".join(held.masked_texts(ids, mask)).encode()).hexdigest() == hashlib.sha256((text * 2).encode()).hexdigest()
