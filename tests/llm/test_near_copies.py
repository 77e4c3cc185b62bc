"""The pipeline's near-duplicate stage against Jaccard similarities of runs of five words."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import plain
import pytest

from episodica.llm import shingles, simhash

SF = "/root/testdata/sf0.001"


def likeness(a, b):
    a, b = plain.five_word_runs(a), plain.five_word_runs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def stage(spark, rows):
    kept = corpus_pipeline.drop_near_duplicates(spark, plain.table_of(spark, [(i, t, "en", "a", len(t)) for i, t in rows]), SF)
    return {(r.doc_id, r.text) for r in kept.collect()}


def test_planted_copies(spark):
    r = random.Random(3)
    rows, gone = [], set()
    for k, edits in enumerate([1, 2, 3, 5, 8, 10, 11, 12, 30, 60]):
        base = [f"w{r.randrange(10**6)}" for _ in range(500)]
        copy = list(base)
        for at in r.sample(range(10, 490), edits):
            copy[at] = f"x{r.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        gone |= {2 * k + 1} if likeness(rows[-2][1], rows[-1][1]) >= 0.8 else set()
    assert len(gone) >= 6 and min(likeness(rows[i - 1][1], rows[i][1]) for i in gone) < 0.85
    assert stage(spark, rows) == {(i, t) for i, t in rows if i not in gone}


def test_chain_of_copies_is_one_component(spark):
    whole = [f"w{k}" for k in range(400)]
    chain = [(10 - k, " ".join(whole[30 * k : 30 * k + 290])) for k in range(4)]
    assert likeness(chain[0][1], chain[1][1]) >= 0.8 > likeness(chain[0][1], chain[2][1])
    assert stage(spark, chain) == {chain[-1]}


def test_awkward_rows(spark):
    """Repeated rows, null ids and texts, clashing columns: one whole row of each component stays."""
    df = plain.table_of(spark)
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns
    sets = [plain.five_word_runs(r[1]) for r in plain.ROWS]
    held = defaultdict(list)
    for r, c in zip(plain.ROWS, plain.components_of(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))):
        held[c].append(r)
    want = [min(v, key=lambda r: (r[0] is None, r[0] or 0)) for v in held.values()]
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(repr((*r, *plain.CLASHING)) for r in want)


@pytest.mark.parametrize("cell", [8192, 3])
def test_what_a_path_misses(spark, cell):
    """Copies of a text among texts that share half of it: some neighbours on a path are unlike, and no link may be lost."""
    r = random.Random(8)
    shared = [f"s{k}" for k in range(200)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{k}" for k in range(60)]
        for c in range(4):
            text = shared + own
            text[10 * c + 5] = f"edit{g}{c}"
            rows.append((100 * g + c, " ".join(text)))
    r.shuffle(rows)
    sets = [plain.five_word_runs(t) for _, t in rows]
    held = defaultdict(list)
    for (i, _), c in zip(rows, plain.components_of(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))):
        held[c].append(i)
    assert 1 < len(held) < len(rows)
    kept = simhash.first_of_each(plain.table_of(spark, [(i, t, "en", "a", len(t)) for i, t in rows]), cell=cell)
    assert {x.doc_id for x in kept.select("doc_id").collect()} == {min(v) for v in held.values()}


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    a, b = ("one text about a fox and a dog in the yard", "some other words that share nothing with it at all")
    assert stage(spark, [(1, b), (5, a), (5, b), (5, a), (None, a), (None, "a third text that has no id to be known by")]) == {
        (1, b), (5, a), (None, "a third text that has no id to be known by")
    }


def test_parities_never_say_that_copies_are_unlike():
    """Sets of all sizes at and around 0.8: what parities differ in is no more than what the sets differ in."""
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 40, 300, 5000):
        for share in (0.0, 0.05, 0.1, 0.2, 0.5, 1.0):
            a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(share * len(a)) :], r.integers(0, 1 << 62, int(share * len(a)), dtype=np.uint64)]))
            odd = shingles.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
            differ = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
            both = len(np.intersect1d(a, b))
            assert differ <= len(a) + len(b) - 2 * both
            if both >= 0.8 * (len(a) + len(b) - both):
                assert differ <= shingles.most_apart(len(a), len(b))
    assert not shingles.parities(np.zeros(0, np.uint64), np.array([0])).any()
