"""Ids of texts that spell the vocabulary's added token, against the tokenizers library as it is set by default."""

import numpy as np
import plain
import pytest
import public_tokenizers
import zlib
from tokenizers import Tokenizer

from episodica.llm import packing, tokens

END = "<|endoftext|>"
TEXTS = [f"a {END} b", END, f"{END}{END}", f" {END} ", f"one two{END}three  four {END}\n", f"<|endoftext|{END}", "no such token", f"é🙂{END}ü", "<|endof text|>"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(text):
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    got = np.frombuffer(tokens.Encoder(tokens.vocabulary_path()).ids(text), "<u4").tolist()
    assert got == want and got.count(50256) == text.count(END)


def test_pieces(spark):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.best_fit_packing(plain.table_of(spark, [(k, t, "en", "a", len(t)) for k, t in enumerate(TEXTS)])).collect()
    ids = [[*encode.encode(t, add_special_tokens=False).ids, 2] for t in TEXTS]
    assert {(r.doc_id, r.length, r.ids_crc32) for r in got} == {(k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in enumerate(ids)}
