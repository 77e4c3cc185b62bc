"""Sketches against plain ones, and of short texts against the containment of their runs of five words."""

import struct

import plain
import pytest
import xxhash

from episodica.llm import fingerprints


def test_short_texts_contained_in_a_long_one(spark):
    long = [f"w{k}" for k in range(3000)]
    rows = [(" ".join(long[k : k + n]), " ".join(long), 1.0) for n in (5, 10, 30) for k in range(0, 2900, 100)]
    rows += [(" ".join(long[k : k + 5] + [f"x{j}" for j in range(5)]), " ".join(long), 1 / 6) for k in range(0, 2900, 100)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    got = df.select("want", fingerprints.containment(fingerprints.sketch(df["a"]), fingerprints.sketch(df["b"])).alias("c")).collect()
    assert [r.c for r in got] == [r.want for r in got]


def plain_sketch(text):
    """Hashes of runs of five words: each word's hash goes into the next one's seed."""
    hashes = [xxhash.xxh64_intdigest(w, seed=42) for w in plain.words(text)]
    out = set()
    for k in range(max(1, len(hashes) - 4) if hashes else 0):
        h = 42
        for word in hashes[k : k + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", word), seed=h)
        out.add(h >> 1)
    return out


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_every_column_against_plain_sketches(spark, which):
    if which == "awkward":
        df, rows = plain.table_of(spark), [(r[0], r[1] or "") for r in plain.ROWS if r[0] != 9]
        df = df.where("doc_id IS NULL OR doc_id <> 9")  # lower case beyond A-Z differs there
    else:
        df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
        rows = [(r.doc_id, r.text or "") for r in df.collect() if (r.text or "").lower().encode() == (r.text or "").encode().lower()]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)

    def like(a, b):
        return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / min(len(a), len(b))

    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        a, b, c = plain_sketch(t), plain_sketch(t[: len(t) - half] + after[:half]), plain_sketch(after)
        hexed = ["".join(f"{h:016x}" for h in sorted(s)) for s in (a, b)]
        want.append(repr((i, *hexed, round(like(a, b), 9), round(like(a, c), 9))))
    got = fingerprints.neighbours(df).collect()
    assert sorted(want) == sorted(repr((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))) for r in got)
