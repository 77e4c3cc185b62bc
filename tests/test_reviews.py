"""Resumable calls of a model, decisions on what it answers, and streams matched over slices of time."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import align, verify


def calls_in(folder):
    return sorted(line for p in folder.iterdir() for line in p.read_text().splitlines())


def counting(folder, dies_after=None):
    """A client that writes down each call it answers, and whose task dies after some of them."""

    def client():
        seen = []

        def call(prompt):
            if prompt == "bad":
                raise ValueError("no")
            if dies_after is not None and len(seen) >= dies_after:
                raise SystemExit("the task dies")
            seen.append(prompt)
            with open(folder / str(os.getpid()), "a") as out:
                out.write(prompt + "\n")
            return prompt.upper()

        return call

    return client


def test_every_request_is_answered_once(spark, tmp_path):
    """Tasks die half-way, again and again: each run goes on where the last one was, and asks nothing twice."""
    (tmp_path / "calls").mkdir()
    log, prompts = str(tmp_path / "log"), [f"p{k}" for k in range(40)]
    requests = spark.createDataFrame([(f"r{k}", p) for k, p in enumerate(prompts)] + [("r40", "bad"), ("r0", "p0")], "request_id string, prompt string")
    for _ in range(2):
        with pytest.raises(Exception):
            verify.ask_once(requests, log, counting(tmp_path / "calls", 3), at_once=3, retries=1)
    some = calls_in(tmp_path / "calls")
    assert 6 <= len(some) < 40 and len(set(some)) == len(some) and verify.logged(spark, log).where("error IS NULL").count() == len(some)
    got = {r.request_id: (r.raw_response, r.error) for r in verify.ask_once(requests, log, counting(tmp_path / "calls"), at_once=3, retries=1).collect()}
    assert got == {f"r{k}": (p.upper(), None) for k, p in enumerate(prompts)} | {"r40": (None, "ValueError: no")}
    assert calls_in(tmp_path / "calls") == sorted(prompts)
    again = {r.request_id: r.raw_response for r in verify.ask_once(requests.withColumn("prompt", F.lit("now")).where("request_id = 'r40'"), log, counting(tmp_path / "calls"), retries=1).collect()}
    assert again == {"r40": "NOW"} and calls_in(tmp_path / "calls") == sorted([*prompts, "now"])
    assert verify.ask_once(requests, log, counting(tmp_path / "calls", 0), at_once=2).count() == 41  # nothing is left to ask


def test_files_of_several_replies_and_cut_ends(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    requests = spark.createDataFrame([(f"r{k}", f"p{k}") for k in range(10)], "request_id string, prompt string")
    log = tmp_path / "log"
    assert verify.ask_once(requests, str(log), counting(tmp_path / "calls"), at_once=2, per_file=4).count() == 10
    held = [p for p in log.iterdir() if p.suffix == ".json"]
    assert len(held) <= 4 and sum(len(p.read_text().splitlines()) for p in held) == 10
    (log / "run-x-0-0-0.json").write_text(json.dumps({"request_id": "r99", "raw_response": "x", "answered_at": 1.0}) + '\n{"request_id": "r98", "raw')
    assert verify.logged(spark, str(log)).count() == 11
    assert verify.logged(spark, str(tmp_path / "none")).count() == 0


def test_an_episodes_decisions(spark):
    points = spark.createDataFrame([(1, i + 1, c, 300) for i, c in enumerate((40, 80, 81, 82, 160, 200))], "ep long, i long, c long, n long")
    asked = verify.point_requests(points, list("abcdef"), fps=30, task="t")
    rows = {r.i: r for r in asked.collect()}
    assert rows[1].request_id == "000001-1" and (rows[1].lo, rows[1].hi) == (0, 79) and rows[1].frames == [0, 13, 26, 40, 53, 66, 79]
    assert (rows[3].lo, rows[3].hi) == (51, 111)  # its neighbours leave no room
    assert "frames 0, 13, 26" in rows[1].prompt and "Judge by the images alone" in rows[1].prompt
    reply = lambda frame, sure="high", seen="x": json.dumps({"selected_frame": frame, "confidence": sure, "visual_evidence": seen})
    answers = [("000001-1", reply(30), None), ("000001-2", f"Well: {reply('70.5')}", None), ("000001-3", reply(90, "low"), None), ("000001-4", None, "TimeoutError"), ("000001-5", "no json", None)]
    found = verify.decided(asked, spark.createDataFrame(answers, "request_id string, raw_response string, error string"), fps=30)
    got = {r.i: (r.selected, r.delta, r.confidence, r.decision, r.to) for r in found.collect()}
    assert got[1] == (26, -14, "high", "record_only_non_p2", 40)
    near = min(rows[2].frames, key=lambda x: abs(x - 70))
    assert got[2] == (near, near - 80, "high", "accepted", near)
    assert got[3][2:] == ("low", "confidence_not_high", 81) and got[4] == (82, 0, None, "no_reply", 82) and got[5] == (160, 0, "low", "confidence_not_high", 160)
    report = verify.report(found).first()
    assert (report.moved_points, report.high_conf_points) == (1, 2) and report.state_cps == "40 80 81 82 160 200" and report.proposal_cps == f"40 {near} 81 82 160 200"
    assert report.decisions.split(";")[3] == "no_reply"


def nearest(targets, samples):
    at = np.clip(np.searchsorted(samples, targets), 1, len(samples) - 1) if len(samples) > 1 else np.zeros(len(targets), int)
    return np.where(np.abs(targets - samples[at - 1]) <= np.abs(targets - samples[at]), at - 1, at) if len(samples) > 1 else at


@pytest.mark.parametrize("width", [None, 0.7, 5.0, 1e6])
def test_one_long_episode_over_many_slices(spark, width):
    """Slices without a sample, ties, equal times, samples only at one end: the rows of a search by bisection."""
    r = np.random.default_rng(5)
    cases = {
        1: (np.sort(r.integers(0, 2000, 300)) / 16, np.sort(r.integers(0, 2000, 150)) / 16), 2: (np.arange(40) / 4, np.array([3.0])),
        3: (np.arange(40) / 4, np.array([100.0, 101.0])), 4: (np.arange(20) * 10.0, np.array([0.5, 0.5, 95.0, 105.0, 105.0])), 5: (np.arange(5) / 2, np.array([])),
    }
    left = spark.createDataFrame([(e, float(t), k) for e, (a, _) in cases.items() for k, t in enumerate(a)], "ep long, t double, id long")
    right = spark.createDataFrame([(e, float(t), k) for e, (_, b) in cases.items() for k, t in enumerate(b)], "ep long, t double, v long")
    got = {(x.ep, x.id): x.v for x in align.nearest_sample(left, right, width).collect()}
    for e, (a, b) in cases.items():
        want = nearest(a, b).tolist() if len(b) else [None] * len(a)
        # Of equal times the search takes whichever it meets; any of them is right.
        assert [b[got[e, k]] if len(b) else got[e, k] for k in range(len(a))] == [b[w] if len(b) else w for w in want], e


def test_alignment_falls_back(spark):
    hands = spark.createDataFrame([(e, 61) for e in range(1, 6)], "ep long, n long")
    times = spark.createDataFrame([(e, k, 1000.0 + k / 60) for e in (1, 2, 4) for k in range(61)], "ep long, place long, t double")
    videos = spark.createDataFrame([(1, 31), (2, 31), (3, 31), (4, 0)], "ep long, frames long")
    stamps = spark.createDataFrame([(e, k, 5_000_000_000 + k * 33_000_000) for e, n in ((1, 31), (2, 30), (3, 31)) for k in range(n)], "ep long, place long, t long")
    starts = spark.createDataFrame([(1, 990_000_000, 4_000_000), (3, 990_000_000, 4_000_000)], "ep long, unix_us long, ticks_us long")
    got = {r.ep: r for r in align.alignment_report(hands, times, videos, stamps, starts).collect()}
    one = got[1]
    assert (one.ok, one.hand_frames, one.hand_dur_s, one.ego_frames, one.ego_dur_s, one.ego_first_used, one.ego_last_used) == (True, 61, 1.0, 31, 0.99, 0, 30)
    assert one.device_clock_offset_s == -9.0
    assert (got[2].ego_dur_s, got[2].ego_first_used, got[2].ego_last_used, got[2].device_clock_offset_s) == (None, 0, 30, None)
    assert got[3].hand_dur_s == 1.0 and got[3].device_clock_offset_s is None and got[3].ego_last_used == 30
    for ep in (4, 5):
        assert (got[ep].ok, got[ep].reason, got[ep].hand_frames, got[ep].ego_last_used) == (False, "no ego video", None, None)
    moved = align.matched(hands, times, videos, stamps, offset_s=0.33).where("ep = 1").agg(F.min("at"), F.max("at")).first()
    assert tuple(moved) == (10, 30)
    stretched = {r.f: r["at"] for r in align.matched(hands, times, videos, stamps, mode="share").where("ep = 1").collect()}
    assert stretched[0] == 0 and stretched[60] == 30 and stretched[30] == 15
