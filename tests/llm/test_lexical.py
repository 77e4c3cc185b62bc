"""Ranked lexical search against a plain full scan."""

import math
import re
from collections import Counter

import numpy as np
import plain

from episodica.llm import lexical

ITEMS = [(0, "The quick brown FOX over the lazy dog"), (1, None), (2, " ..!"), (None, "lorem ipsum"), (4, "straße ÄÖÜ 42 zzz"), (0, "The quick brown FOX over the lazy dog"), (5, "dog dog dog fox")]


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def scan(docs, items, k=10, multiplicity=False):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, all_ = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * n) // max(all_, 1)
            asked = Counter(terms(text))
            score = sum((x if multiplicity else 1) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    """Nulls, empty and very long texts, copies, ties, clashing columns, repeated items; in one block and in several."""
    docs, items = [(r[0], r[1]) for r in plain.ROWS], spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, score string")
    for other in ({}, {"multiplicity": True}, {"k": 2}, {"k": 2, "block_items": 2}, {"block_bytes": 30}):
        want = scan(docs, ITEMS, **{a: b for a, b in other.items() if not a.startswith("block")})
        assert want and rows(lexical.search(plain.table_of(spark), items, **other)) == want, other


def test_a_group_of_copies_over_many_parts(spark):
    """Far more equal scores than k, over many tasks: the least ids stay, once for each row."""
    docs = [(i // 2, "one text of many") for i in range(2000)] + [(-i, f"text {i}") for i in range(500)]
    items = [(1, "many copies of one text"), (2, "text")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(31), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == scan(docs, items)


def test_lengths_beyond_64_bits():
    n = np.array([10, 1 << 40], np.int64)
    got = lexical.impacts(np.array([3, 3]), n, 1 << 30, 1 << 50)
    assert got.tolist() == [3_000_000_000 // (3000 + 8 * (10 + 90 * x * (1 << 30) // (1 << 50))) for x in n.tolist()]


def test_empty_tables(spark):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), plain.table_of(spark, [])
    assert lexical.search(none, items).collect() == []
    assert lexical.search(plain.table_of(spark), items.limit(0)).collect() == []
