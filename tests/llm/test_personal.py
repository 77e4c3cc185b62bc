"""Weak supervision: planted data that the patterns miss, estimated reliabilities, and long texts."""

import random
import time

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from episodica.llm import personal
from episodica.llm.expressions import apart, matches, running

r = random.Random(11)
LAST = "Berger Kowalski Fontaine Okafor Lindqvist Marchetti Devaney Hruska Tanaka Oduya Petrov Salazar Whitlock Brandt".split()
STREET = "Maple Juniper Harbor Whitfield Orchard Lindell".split()
PROSE = "the system was moved over to another place while nobody kept watch on what it did and so on".split()


def digits(n):
    return "".join(r.choice("0123456789") for _ in range(n))


def personal_data():
    return r.choice((
        lambda: (r.choice(["Dear ", "name: ", "contact Mr. ", "patient "]), f"{r.choice(personal.GIVEN)} {r.choice(LAST)}", r.choice([", born in spring", " said so", " and others", ", email follows"])),
        lambda: (r.choice(["lives at ", "address: ", "resident of "]), f"{r.randint(1, 999)} {r.choice(STREET)} {r.choice(['Street', 'Avenue', 'Lane'])}", r.choice([", flat two", " for long", "."])),
        lambda: (r.choice(["call ", "tel: ", "mobile ", "ssn "]), r.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]), r.choice([" today", ".", ", phone"])),
        lambda: (r.choice(["write to ", "mail ", "reach me via "]), f"{r.choice(LAST).lower()}{digits(2)} {r.choice(['(at)', '[at]'])} host{digits(1)} {r.choice(['(dot)', '[dot]'])} {r.choice(['com', 'org', 'de'])}", r.choice([" soon", "."])),
    ))()


def harmless():
    return r.choice((
        lambda: ("the ", f"{r.choice(STREET)} {r.choice(['Museum', 'Valley', 'Bridge'])}", " river was near"),
        lambda: ("version ", f"20{digits(2)}{r.choice(['01', '11'])}{r.choice(['05', '27'])}", " bytes"),
        lambda: ("total ", digits(8), " units"),
        lambda: ("isbn ", digits(13), " pages"),
        lambda: ("city of ", f"North {r.choice(STREET)}", " company"),
    ))()


@pytest.fixture(scope="module")
def planted(spark):
    rows = []
    for k in range(1200):
        lead, found, tail = personal_data() if k % 2 else harmless()
        head = " ".join(r.choice(PROSE) for _ in range(12)) + " " + lead
        rows.append((k, head + found + tail, len(head), len(head) + len(found), k % 2))
    return spark.createDataFrame(rows, "doc_id long, text string, a int, b int, own int"), rows


def test_spans_that_the_patterns_miss(spark, planted):
    df, rows = planted
    got = {x.doc_id: x.spans for x in personal.find_personal(df).collect()}
    hit = {i: any(s.start < b and a < s.end for s in got[i]) for i, _, a, b, _ in rows}
    recall = np.mean([hit[i] for i, *_, own in rows if own])
    wrong = np.mean([bool(got[i]) for i, *_, own in rows if not own])
    missed = np.mean([not plain.base(t, plain.PERSONAL, False)[2] for _, t, _, _, own in rows if own])
    assert recall >= 0.9 and wrong <= 0.05 and missed > 0.9, (recall, wrong, missed)


def test_redacting_leaves_no_span(spark, planted):
    df, rows = planted
    got = {x.doc_id: x.text for x in personal.redact(df).select("doc_id", "text").collect()}
    assert np.mean([t[a:b] in got[i] for i, t, a, b, own in rows if own]) <= 0.1
    assert np.mean([got[i] == t for i, t, *_, own in rows if not own]) >= 0.95


def test_reliabilities_of_simulated_labelers():
    """EM finds the error rates of labelers that abstain, without seeing the truth."""
    s = np.random.default_rng(3)
    truth = s.random(20000) < 0.3
    right = (0.95, 0.9, 0.8, 0.85)
    votes = [np.where(s.random(20000) < 0.3, "-", np.where((s.random(20000) < q) == truth, "1", "0")) for q in right]
    counts: dict[str, float] = {}
    for v in zip(*votes):
        counts["".join(v)] = counts.get("".join(v), 0) + 1
    prior, rates, post = personal.reliabilities(counts)
    assert abs(prior - 0.3) < 0.03
    for k, q in enumerate(right):
        said_yes = rates[k, 0, 1] / (rates[k, 0, 1] + rates[k, 1, 1])
        assert abs(said_yes - q) < 0.03
    assert post["1111"] > 0.99 > 0.01 > post["0000"]


def test_running_and_apart(spark):
    s = random.Random(5)
    for _ in range(6):
        n = [s.randint(-5, 9) for _ in range(s.randint(0, 40))]
        spans = [(a, a + s.randint(1, 6)) for a in (s.randint(0, 60) for _ in range(s.randint(0, 8)))]
        more = sorted((a, a + s.randint(1, 6)) for a in (s.randint(0, 60) for _ in range(s.randint(0, 12))))
        kind = "n array<long>, spans array<struct<start:long,end:long>>, more array<struct<start:long,end:long>>"
        row = spark.createDataFrame([(n, spans, more)], kind).select(
            running(F.col("n"), lambda x, y: x + y).alias("total"), running(F.col("n"), F.greatest).alias("most"), apart(F.col("spans"), F.col("more")).alias("left")
        ).first()
        assert row.total == [sum(n[: k + 1]) for k in range(len(n))] and row.most == [max(n[: k + 1]) for k in range(len(n))]
        assert sorted(map(tuple, row.left)) == [(a, b) for a, b in more if not any(x < b and a < y for x, y in spans)]


def test_many_matches_in_one_text(spark):
    text = "a@b.co " * 100_000
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    began = time.time()
    got = {x.doc_id: (x.n, x.last) for x in personal.find_personal(df).select("doc_id", F.size("spans").alias("n"), F.try_element_at("spans", F.lit(-1))["start"].alias("last")).collect()}
    assert got[1] == (100_000, 7 * 99_999) and got[2][0] == got[3][0] == 0
    assert time.time() - began < 60
    assert matches is not None


def test_titles_of_the_documents_stay(spark):
    """What only one labeler votes for is no span: names of licences and repeated pairs of capitalised words stay in the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = [s for x in personal.find_personal(docs).collect() for s in x.spans if s.kind not in personal.KINDS]
    # What is added are numbers with a card's beginning and check digit next to others, which the card pattern takes together.
    assert all(s.kind == "number" and s.votes[2] == "1" and personal.agreed(s.votes) for s in more)
    before, after = (sum("Apache License" in (r.text or "") for r in df.select("text").collect()) for df in (docs, personal.redact(docs)))
    assert before == after > 0
    assert personal.agreed("-11---") and personal.agreed("11-0-1") and not any(map(personal.agreed, ("-1----", "11-00-", "------", "-1-0--")))
