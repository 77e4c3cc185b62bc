"""Normalised stage lists against a plain fold over random and odd lists."""

import numpy as np
from pyspark.sql import functions as F

from episodica.functions import replies
from episodica.operators import intervals

NAMES = ["reach", "Lift", "place", None, "odd", "done", "transport"]


def fold(items, length):
    """The list as one stage after the other makes it, with what had to be changed."""
    out, before, changed, renamed = [], -1, False, 0
    for k, (name, stage, start, end, bad) in enumerate(items):
        if name != stage:
            renamed, changed = renamed + 1, True
        first = before + 1
        a = first if bad or start is None else start
        b = a if bad or end is None else end
        changed |= bad or a != first
        if k == len(items) - 1:
            changed |= b != length - 1
            b = length - 1
        else:
            b = max(first, min(b, length - 1))
        if first >= length:
            changed = True
            break
        out.append((stage, first, b, name if name != stage else None))
        before = b
    if not out:
        return [("global", 0, length - 1, None)], True, renamed
    return out, changed, renamed


def test_random_lists(spark):
    r = np.random.default_rng(3)
    cases = {}
    for ep in range(400):
        n, items, at = int(r.integers(1, 40)), [], 0
        for _ in range(int(r.integers(0, 8))):
            name = NAMES[r.integers(len(NAMES))]
            stage = {"Lift": "transport", None: "adjust", "odd": "adjust"}.get(name, name)
            tidy = r.random() < 0.6
            start = at if tidy else int(r.integers(-5, 50))
            end = at + int(r.integers(0, 9)) if tidy else int(r.integers(-5, 50))
            at = end + 1
            items.append((name, stage, start if r.random() < 0.9 else None, end if r.random() < 0.9 else None, bool(r.random() < 0.05)))
        cases[ep] = (n, items)
    cases[1000] = (10, [("reach", "reach", 0, -3, False), ("done", "done", 1, 9, False)])  # an end before its start is clamped without a word
    cases[1001] = (10, [("reach", "reach", 0, 9, False), ("Lift", "transport", 10, 12, False), ("Lift", "transport", 13, 14, False)])  # a renamed one behind the end counts, the next not
    rows = [(ep, k, *item, n) for ep, (n, items) in cases.items() for k, item in enumerate(items, 1)]
    rows += [(ep, None, None, None, None, None, None, n) for ep, (n, items) in cases.items() if not items]
    df = spark.createDataFrame(rows, "ep long, i long, name string, stage string, first long, last long, bad boolean, n long")
    got = {x.ep: x for x in intervals.normalised_stages(df).collect()}
    for ep, (n, items) in cases.items():
        stages, changed, renamed = fold(items, n)
        x = got[ep]
        assert ([tuple(s) for s in x.stages], x.changed, x.renamed, x.coverage_ok, x.stage_count) == (stages, changed, renamed, True, len(stages)), (ep, n, items)
    assert not got[1000].changed or fold(cases[1000][1], 10)[1]
    assert got[1001].renamed == 1


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("Lift ", "open", None, "x", "DONE")], "n string")
    assert [r[0] for r in df.select(replies.stage_name(F.coalesce("n", F.lit("adjust")))).collect()] == ["transport", "release", "adjust", "adjust", "done"]
