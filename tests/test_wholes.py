"""Payload texts, profiles, compaction and resume as literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import enrich, query, recall

E = "id long, name string, type string, description string, created string, updated date, last_referenced timestamp"
R, P = "source_id long, target_id long, relation string, weight double, created date", "entity_id long, key string, value string, updated date"


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame([(1, "axios-client", "tool", "an http client " * 9, "2024-03-04", None, None), (2, "deploy-bug", "incident", "x" * 100, "2024-03-05", None, None), (3, "lesson-npm", "lesson", "pin versions", "2024-03-06", None, None), (4, "silent", "tool", None, "2024-03-07", None, None)], E).withColumn("created", F.to_date("created"))
    r = spark.createDataFrame([(1, 2, "caused", 0.7, None)], R)
    p = spark.createDataFrame([(1, "doc", "docs/axios.md", None), (1, "rationale", "fast", None), (3, "trigger-tool", '["npm install"]', None), (3, "severity", "high", None)], P)
    return Graph(e, r, p)


def test_payload(spark, graph):
    texts = ["how does the axios-client behave today?", "tell me more on axios-client and silent", "and then npm install went wrong again in the nightly build, which is odd"]
    messages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session_id long, turn long, text string")
    got = {r["turn"]: r["payload"] for r in recall.recall(graph, messages, fuzzy=False).collect()}
    assert got[0].split("\n") == [
        recall.ASKED, "Matched: axios-client", "  axios-client [tool]: " + ("an http client " * 9)[:80], "Connected (1-hop):", "  deploy-bug [incident]: " + "x" * 60,
        "Relationships:", "  axios-client --[caused]--> deploy-bug [0.7]", "Properties:", "  axios-client.doc = docs/axios.md", "  [Deep context available: docs/axios.md]", "  axios-client.rationale = fast", recall.HINT,
    ]
    assert got[1].split("\n") == [recall.LATER, "Matched: silent", "  silent [tool]: (no description)"]
    assert got[2].split("\n") == ["LESSON ACTIVATION (from conversation context):", "* lesson-npm [HIGH]: pin versions", "  Triggered by: 'npm install' mentioned in message.", "Consider these lessons before proceeding."]


def test_profile(spark, graph):
    got = [tuple(r) for r in query.entity_profile(graph, spark.createDataFrame([("Axios-Client",)], "name string")).orderBy("pos", "label").collect()]
    assert got == [
        ("axios-client", "header", "description", "an http client " * 9, None, None, -1), ("axios-client", "header", "since", "2024-03-04", None, None, -1), ("axios-client", "header", "type", "tool", None, None, -1),
        ("axios-client", "property", "rationale", "fast", None, None, 0), ("axios-client", "property", "doc", "docs/axios.md", None, None, 1), ("axios-client", "out", "caused", "deploy-bug", "incident", 0.7, 2),
    ]


def compact(spark, *events):
    lines = spark.createDataFrame([(1, i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)], "session_id long, seq long, line string")
    return [r.asDict(recursive=True) for r in enrich.compact_events(lines).orderBy("seq").collect()]


def test_compaction(spark):
    block = lambda *bs: {"type": "assistant", "uuid": "u", "cwd": "/w", "gitBranch": "b", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "assistant", "model": "m", "usage": {"x": 1}, "content": list(bs)}}
    got = compact(
        spark,
        block({"type": "tool_use", "id": "i", "name": "Bash", "input": {"command": "c" * 1300, "n": 3, "deep": {"a": "d" * 900}, "short": "s"}}),
        block({"type": "tool_use", "name": "Bash", "input": "y" * 801}, {"type": "tool_use", "name": "T", "input": [1, 2]}, {"type": "tool_use", "name": "U"}),
        block({"type": "tool_result", "content": "r" * 601, "is_error": True}, {"type": "tool_result", "content": [{"type": "text", "text": "t" * 700}, {"type": "image", "source": "z"}, {"type": "other"}, {"type": "text"}]}, {"type": "tool_result", "is_error": False}),
        block({"type": "image", "source": "z"}, {"type": "thinking", "thinking": "hm" * 900, "signature": "q"}, {"type": "text", "text": "é" * 2000}, {"type": "odd", "k": [1]}, "bare"),
        {"type": "user", "message": {"role": "user", "content": "plain words"}},
        {"type": "user"}, {"type": "system", "message": {"content": "x"}}, {"type": "file-history-snapshot"}, {"role": "user", "message": {"content": "second dialect"}}, "not json", "[1]", '"text"',
    )
    assert [r["seq"] for r in got] == [0, 1, 2, 3, 4, 5, 8]
    assert {k: got[0][k] for k in ("type", "cwd", "gitBranch", "timestamp", "role")} == {"type": "assistant", "cwd": "/w", "gitBranch": "b", "timestamp": "2024-01-01T00:00:00Z", "role": "assistant"}
    b = [r["blocks"] for r in got]
    assert json.loads(b[0][0]["input"]) == {"command": "c" * 800 + "...[+500]", "n": 3, "deep": {"a": "d" * 900}, "short": "s"} and b[0][0]["name"] == "Bash"
    assert [x["input"] if x["input"] is None else json.loads(x["input"]) for x in b[1]] == ["y" * 800 + "...[+1]", [1, 2], None]
    assert json.loads(b[2][0]["result"]) == "r" * 600 + "...[+1]" and [x["is_error"] for x in b[2]] == [True, None, None]
    assert json.loads(b[2][1]["result"]) == [{"type": "text", "text": "t" * 600 + "...[+100]"}, {"type": "text", "text": ""}] and b[2][2]["result"] is None
    assert [x["type"] for x in b[3]] == ["thinking", "text", "odd", None]
    assert b[3][0]["text"] == "hm" * 900 and b[3][1]["text"] == "é" * 2000 and json.loads(b[3][2]["other"]) == {"type": "odd", "k": [1]} and json.loads(b[3][3]["other"]) == "bare"
    assert got[4]["content"] == "plain words" and got[4]["blocks"] is None and got[5]["content"] is None and got[6]["content"] == "second dialect"


def test_resume_keeps_what_finished_files_gave(spark):
    one = lambda *fs: spark.createDataFrame([(f,) for f in fs], "file string")
    found = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), ("c", "half")], "file string, name string")
    pending, progress, kept = enrich.resume_pending(one("a", "b", "c", "d"), one("a", "b", "b", "gone"), found)
    assert sorted(r["file"] for r in pending.collect()) == ["c", "d"] and progress.first()["fraction"] == 0.5
    assert sorted(map(tuple, kept.collect())) == [("a", "x"), ("b", "y"), ("b", "z")]
    assert enrich.resume_pending(one("a"), one(), None)[2] is None
