"""Clients against a server of this process, proposals of a model, and documents of fused tracks."""

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from episodica.functions import clients
from episodica.operators import prior, verify


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            if "messages" in body:
                parts = body["messages"][0]["content"]
                said = {"choices": [{"message": {"content": f"{parts[0]['text']} with {len(parts) - 1}"}}]}
            else:
                said = {"candidates": [{"content": {"parts": [{"text": "{"}, {"text": "}"}]}}]}
            bad = body.get("model") == "gone"
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *args):
            pass

    held = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}/v1/", seen
    held.shutdown()


def test_calls(server, monkeypatch):
    url, seen = server
    monkeypatch.setenv("SOME_KEY", "k1")
    assert clients.chat("m", url, "SOME_KEY", max_tokens=7)()("look", [b"\1\2", b"\3"]) == "look with 2"
    path, headers, body = seen[-1]
    assert path == "/v1/chat/completions" and headers["Authorization"] == "Bearer k1" and (body["temperature"], body["max_tokens"], body["model"]) == (0.0, 7, "m")
    assert body["messages"][0]["content"][1]["image_url"]["url"] == "data:image/jpeg;base64," + base64.b64encode(b"\1\2").decode()
    assert clients.generate("m2", url, "SOME_KEY")()("look") == "{}" and seen[-1][0] == "/v1/models/m2:generateContent"
    assert seen[-1][2]["generationConfig"]["responseMimeType"] == "application/json" and {k.lower(): v for k, v in seen[-1][1].items()}["x-goog-api-key"] == "k1"
    with pytest.raises(Exception, match="500"):
        clients.chat("gone", url)()("look")


def test_requests_with_images(spark, server, tmp_path):
    url, seen = server
    before = len(seen)
    asked = spark.createDataFrame([("a", "one", [b"x"]), ("b", "two", [b"x", b"y"]), ("c", "three", [])], "request_id string, prompt string, images array<binary>")
    found = {r.request_id: r.raw_response for r in verify.ask_once(asked, str(tmp_path / "log"), clients.chat("m", url), at_once=2).collect()}
    assert found == {"a": "one with 1", "b": "two with 2", "c": "three with 0"} and len(seen) == before + 3
    gone = verify.ask_once(asked.limit(1), str(tmp_path / "other"), clients.chat("gone", url), retries=2, pause=0.0).first()
    assert gone.raw_response is None and gone.error.startswith("HTTPError")


def test_proposals(spark):
    asked = prior.requests(spark.createDataFrame([(e, 100) for e in range(7)] + [(7, 1), (8, 0)], "ep long, n long"), fps=10, frames=5)
    rows = {r.ep: r for r in asked.collect()}
    assert rows[0].frames == [0, 25, 50, 74, 99] and rows[7].frames == [0] and 8 not in rows and "#25 2.5s" in rows[0].prompt and '"c3_start_wipe": frame' in rows[0].prompt
    reply = lambda *points: json.dumps(dict(zip(prior.KEYS, points)))
    said = {0: "first\n" + reply(10, "20.5", 30.5, 40, 50), 1: reply(10, 20, 30, 40), 2: reply(10, 20, "x", 40, 50), 3: "none", 4: reply(-5, 50, 40, 99, 200), 5: reply(10, "nan", 30, 40, 50), 6: reply(10, "inf", 30, 40, 50)}
    answers = spark.createDataFrame([(f"prior-{e:06d}", r) for e, r in said.items()], "request_id string, raw_response string")
    got = {r.ep: (r.points, r.flags) for r in prior.proposed(asked, answers).collect()}
    shares = ([20, 37, 50, 77, 91], [prior.FLAG])
    assert got[0] == ([10, 20, 30, 40, 50], []) and got[4] == ([1, 50, 51, 98, 99], []) and all(got[e] == shares for e in (1, 2, 3, 5, 6))


def test_documents_of_fused_tracks(spark):
    state = {1: ([10, 20, 30, 40, 50, 60], 100), 2: ([10, 20, 30, 40, 50, 60], 100), 3: ([1, 2, 3, 4, 5, 6], 8), 4: ([10, 20, 30, 40, 50, 60], 100)}
    other = {1: [10, 23, 38, 40, 50, 60], 2: [10, 29, 30, 40, 50, 60], 4: [10, 24, 30, 40, 50, 60]}
    rows = lambda tracks: [(e, i, c) for e, cs in tracks.items() for i, c in enumerate(cs, 1)]
    a = spark.createDataFrame([(e, i, c, state[e][1]) for e, i, c in rows({e: cs for e, (cs, _) in state.items()})], "ep long, i long, c long, n long")
    a = a.withColumn("c", F.when((F.col("ep") == 4) & (F.col("i") == 3), 22).otherwise(F.col("c")).cast("long"))
    b = spark.createDataFrame(rows(other), "ep long, i long, c long")
    got = {r.episode_index: r for r in prior.fused_documents(a, b, 5, [2]).collect()}
    assert got[1].critical_points == [10, 23, 30, 40, 50, 60] and got[1].review_points == [3] and got[1].flags == [] and got[1].sources[1] == "other"
    assert got[2].critical_points[1] == 20 and got[2].review_points == [2] and got[2].flags == ["p2: vlm-owned but disagrees, used state"] and got[2].disagree_frames == [0, 9, 0, 0, 0, 0]
    assert got[3].flags == ["no vlm annotation -> all points from state"] and got[3].review_points == [1, 2, 3, 4, 5, 6] and got[3].disagree_frames == [None] * 6
    assert got[4].critical_points == [10, 24, 25, 40, 50, 60] and got[4].flags == ["nudged p3 for ordering"] and got[4].review_points == [3]
