"""Packing into windows: every id once, gapless, without padding; best fit as a plain search finds it."""

from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from episodica.llm import queries, windows

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(got, rows, capacity, least=1):
    """Puts the pieces together again; returns the ids of padding."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        parts[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(t))
    assert set(parts) == set(want)
    for i, held in parts.items():
        assert Counter((n, s, x) for s, ids, n in held for s, x in enumerate(ids, s)) == Counter((len(ids), s, x) for ids in want[i] for s, x in enumerate(ids))
    padding = 0
    for held in sequences.values():
        held.sort()
        assert [o for o, *_ in held] == [sum(n for _, n, _ in held[:k]) for k in range(len(held))]
        used = sum(n for _, n, _ in held)
        assert used <= capacity and {t for *_, t in held} == {used}
        if used & (used - 1):
            assert capacity - used < least or used < least
            padding += capacity - used
    return padding


@pytest.mark.parametrize("other", [{}, {"capacity": 64}, {"part_bytes": 20_000}, {"part_rows": 3, "capacity": 256}])
def test_awkward_rows(spark, other):
    rows = [(r[0], r[1]) for r in plain.ROWS]
    assert check(windows.pack(plain.table_of(spark), **other).collect(), rows, other.get("capacity", 2048)) == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = windows.pack(docs).collect()
    assert check(got, rows, 2048) == 0
    short = {r.doc_id: 0 for r in got if r.doc_tokens <= 2048}
    for r in got:
        if r.doc_id in short:
            short[r.doc_id] += 1
    assert sum(n > 1 for n in short.values()) <= 0.05 * len(short)  # few short documents are cut
    assert check(windows.pack(docs, least=64).collect(), rows, 2048, 64) < 0.02 * sum(r.length for r in got)


def test_query_has_the_sums_of_the_ids(spark):
    import zlib

    rows = {(r.doc_id, r.start, r.length): r.ids_crc32 for r in queries.op12_windows(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        ids = np.array(ids_of(r.text), "<u4")
        for (i, s, n), crc in rows.items():
            assert i != r.doc_id or crc == zlib.crc32(ids[s : s + n].tobytes())


def test_best_fit_is_the_tightest_window(spark):
    r = np.random.default_rng(7)
    for _ in range(40):
        capacity = int(r.choice([8, 64, 100, 2048]))
        sizes = r.integers(1, capacity + 1, r.integers(0, 200))
        got = windows.best_fit_decreasing(sizes, capacity)
        room, made = [], {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            fits = [x for x in room if x >= sizes[i]]
            made[i] = min(fits) if fits else capacity
            if fits:
                room.remove(min(fits))
            room.append(made[i] - int(sizes[i]))
        free = np.full(int(got.max(initial=-1)) + 1, capacity)
        for i in np.argsort(-sizes, kind="stable").tolist():
            assert free[got[i]] == made[i]
            free[got[i]] -= sizes[i]
        assert (free >= 0).all()


def test_closing_leaves_powers_of_two():
    """Lengths of which no two fit together, as those of a large group of copies: all are full after the cuts but the last ones."""
    for n, size in ((100, 1100), (1, 1), (7, 2047), (1000, 1025), (3, 2048), (0, 1)):
        sizes = np.full(n, size)
        spans = windows.closed(sizes, windows.best_fit_decreasing(sizes, 2048), 2048)
        used = [sum(b - a for _, a, b in w) for w in spans]
        assert sum(used) == n * size and all(u & (u - 1) == 0 for u in used) and sum(u < 2048 for u in used) <= 11
        held = sorted(s for w in spans for s in w)
        assert [(i, a) for i, a, _ in held] == [(i, 0) if k == 0 or held[k - 1][0] != i else (i, held[k - 1][2]) for k, (i, _, _) in enumerate(held)]


def test_empty_table(spark):
    assert windows.pack(plain.table_of(spark, [])).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        windows.pack(plain.table_of(spark), capacity=100)
