"""Token ids of a public byte-level BPE vocabulary, with a bounded cache of words."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken

# Where white space does not stand as single spaces between words, a text is encoded in one go.
_UNEVEN = re.compile(r"\s |\s\Z| \s")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary file of the tokenizers library as a tiktoken encoding: the same ids, several times as fast."""
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in word): i for word, i in parsed["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder(dict):
    """Little-endian unsigned 32-bit ids of texts. Words are looked up in a cache that is emptied when full."""

    def __init__(self, path: str, most: int = 200_000):
        super().__init__()
        self.encoding, self.most = encoding(path), most
        self.encode, self.special = self.encoding.encode_ordinary, sorted(self.encoding.special_tokens_set)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = array("I", self.encode(" " + word)).tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(token in text for token in self.special):  # added tokens are single ids, which part the text
            return array("I", self.encoding.encode(text, allowed_special="all")).tobytes()
        if _UNEVEN.search(text):
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join([self[word] for word in rest])
