"""Importance resampling against plain counts on awkward rows, small parts and other parameters; its ranks are a sort's."""

import hashlib
import math
import re
import zlib
from collections import Counter

import plain
from pyspark.sql import functions as F

from episodica.llm import importance

TARGET = [(0, "the quick brown fox jumps over the lazy dog"), (1, None), (2, ""), (3, "Zürich ÉTÉ 42 lorem"), (0, "lorem ipsum lorem ipsum")]


def features(text, runs):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [" ".join(words[k : k + n]) for k in range(len(words)) for n in range(1, runs + 1) if k + n <= len(words)]
    return len(words), Counter(zlib.crc32(f.encode()) % 10_000 for f in found)


def resampled(rows, target, percent=5, least=20, runs=3):
    each = [(i, *features(t, runs)) for i, t in rows]
    s, t = sum((f for *_, f in each), Counter()), sum((features(x, runs)[1] for _, x in target), Counter())
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, n, f in each:
        weight = sum(gain(b) * m for b, m in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = may[: percent * len(may) // 100]
    return sorted(((i, f, w, sc) for i, _, f, w, sc in out), key=repr), [(k + 1, r[0], r[4]) for k, r in enumerate(drawn)]


def check(df, rows, target, spark, **other):
    got = importance.resample(df, spark.createDataFrame(target, "item_id long, text string"), **{"least_words" if k == "least" else k: v for k, v in other.items()}).collect()
    every, drawn = resampled(rows, target, **other)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == every
    assert sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None) == drawn
    return drawn


def test_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns; all drawn, and by other parameters."""
    rows = [(r[0], r[1]) for r in plain.ROWS]
    assert not check(plain.table_of(spark), rows, TARGET, spark)
    assert len(check(plain.table_of(spark), rows, TARGET, spark, percent=100, least=0)) == len(rows)
    assert check(plain.table_of(spark), rows, TARGET, spark, percent=60, least=5, runs=2)
    assert check(plain.table_of(spark), rows, [], spark, percent=50, least=1)


def test_many_copies_over_many_parts(spark):
    """A third of all rows has one id and one text: ranks stay unique and without gaps."""
    text = "one text that many rows have, again and again, in the same words as all others that are like it and so on and on and on"
    rows = [(7, text)] * 300 + [(i, f"{text} {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    assert [r[0] for r in check(df, rows, TARGET, spark, percent=90)] == list(range(1, 811))


def test_ranks_are_those_of_a_sort(spark):
    df = spark.range(10_000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), "id")
    got = importance.ranked(df, [F.col("a").desc(), F.col("id").asc()]).collect()
    want = {r: k for k, r in enumerate(sorted(((r.a, r.id) for r in got), key=lambda r: (-r[0], r[1])), 1)}
    assert len(got) == 10_000 and all(want[r.a, r.id] == r.place for r in got)


def test_empty_documents(spark):
    assert importance.resample(plain.table_of(spark, []), spark.createDataFrame(TARGET, "item_id long, text string")).collect() == []
