"""Streams against what the batch operators give, and fuzzy recall against a plain cascade."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions.columns import content_words, name_parts, query_tokens
from graphloom.model import Graph
from graphloom.operators import contain, enrich, lessons, recall
from graphloom.operators.fuzzy import partial_ratio, token_set_ratio
from graphloom.sources import transcripts
from graphloom.streaming import live

E = "id long, name string, type string, description string, created date, updated date, last_referenced timestamp"
CANDIDATE = "event_id long, session_id long, ts timestamp, lesson string, severity string, pattern string"


def _run(stream, out, mode="append"):
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(1, 7, "2024-01-01 10:00:00", x, s, "p") for x, s in (("a", "low"), ("b", "high"), ("c", "medium"), ("d", None))]
    rows += [(2, 7, "2024-01-01 11:00:00", x, s, "p") for x, s in (("a", "low"), ("b", "high"), ("d", None))]
    rows += [(3, 7, "2024-01-01 12:00:00", x, "low", "p") for x in "abcde"] + [(4, 8, "2024-01-01 10:00:00", "b", "high", "q")]
    return spark.createDataFrame(rows, CANDIDATE.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))


def test_cap_and_session_memory(candidates):
    got = {(r["event_id"], r["lesson"]) for r in lessons.activate_lessons(candidates).collect()}
    assert got == {(1, "b"), (1, "c"), (2, "a"), (2, "d"), (3, "e"), (4, "b")}


def test_activate_stream(spark, candidates, tmp_path):
    """A batch, then another: what the first fired stays fired."""
    candidates.where("event_id < 3").write.parquet(f"{tmp_path}/in")
    stream = lambda: live.activate_stream(spark.readStream.schema(candidates.schema).parquet(f"{tmp_path}/in"))
    _run(stream(), f"{tmp_path}/out")
    candidates.where("event_id >= 3").write.mode("append").parquet(f"{tmp_path}/in")
    _run(stream(), f"{tmp_path}/out")
    got = sorted((r["event_id"], r["lesson"]) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    assert got == sorted((r["event_id"], r["lesson"]) for r in lessons.activate_lessons(candidates).collect())


def test_first_stream(spark, candidates, tmp_path):
    candidates.write.parquet(f"{tmp_path}/in")
    _run(live.activate_stream_first(spark.readStream.schema(candidates.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out")
    got = sorted((r["session_id"], r["lesson"]) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    assert got == sorted((r["session_id"], r["lesson"]) for r in lessons.activate_first(candidates).collect())


def test_recall_stream(spark, tmp_path):
    schema = "session_id long, turn long, ts timestamp, question boolean, names array<string>"
    now = datetime(2024, 1, 1, 10)
    rows = [(1, 0, now, False, ["axios"]), (1, 1, now, False, ["axios"]), (1, 2, now, True, ["axios"]), (2, 0, now, False, [])]
    later = [(1, 3, now, False, ["axios", "lexi"])]
    for i, part in enumerate((rows, later)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        _run(live.recall_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out")
    got = sorted((r["session_id"], r["turn"], r["name"], r["first_fire"]) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    assert got == [(1, 0, "axios", True), (1, 2, "axios", False), (1, 3, "lexi", False)]


def test_session_files_once(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    seen = []
    handle = lambda df, _: seen.extend(r["line"] for r in df.collect())
    for name, text in (("a", "one\ntwo\n"), ("deep/b", "three\n")):
        (tmp_path / "in" / f"{name}.jsonl").write_text(text)
        (tmp_path / "in" / f"{name}.txt").write_text("other\n")
        live.process_sessions(spark, str(tmp_path / "in"), str(tmp_path / "ledger"), handle).awaitTermination()
    assert sorted(seen) == ["one", "three", "two"]


def test_scan_sessions(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, text in (("b.jsonl", "{}\n"), ("x/a.jsonl", "{}\n{}\n"), ("empty.jsonl", ""), ("note.md", "no")):
        (tmp_path / name).write_text(text)
    got = [(r["path"].rsplit("/", 1)[1], r["size"]) for r in transcripts.scan_sessions(spark, str(tmp_path)).collect()]
    assert got == [("b.jsonl", 3), ("a.jsonl", 6)]
    assert transcripts.scan_sessions(spark, str(tmp_path), "2100-01-01T00:00:00").count() == transcripts.scan_sessions(spark, str(tmp_path / "none")).count() == 0


def test_containing(spark):
    texts, patterns = ["npm install x", "a", "", "ümlaut/12", None, "a|b 日本語"], ["npm", "l x", "x", "", "/1", "ü", "zzz", "npm install x", "日本", None, "b 日"]
    got = contain.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert {tuple(r) for r in got.collect()} == {(t, p) for t in texts if t for p in patterns if p and p in t}


def test_regex_dialects(spark):
    """Patterns of Python's dialect, among them some that Java's lacks, and text that is no regex in either."""
    patterns = ["(?:a)(?#note)b", r"x(\d)?(?(1)y|z)", "bad (", "fail.*now", "a{,2}c", r"\d+", "(?i)LOUD", "a|b"]
    texts = ["aab here", "x1y and on", "xz and on", "bad ( thing", "it will fail right now", "xaac tail", "loud noise", "12345", "zzzzz"]
    rows = [("error", f"l{i}", i, p, "low") for i, p in enumerate(patterns)]
    triggers = spark.createDataFrame(rows, "kind string, lesson string, pos int, pattern string, severity string")
    events = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate(texts)], "event_id long, session_id long, ts long, output string").selectExpr("event_id", "session_id", "timestamp_seconds(ts) AS ts", "output")

    def found(p, t):
        try:
            return re.search(p, t) is not None
        except re.error:
            return p in t

    assert {(r["event_id"], r["pattern"]) for r in lessons.match_error(events, triggers).collect()} == {(i, p) for i, t in enumerate(texts) for p in patterns if found(p, t)}


def test_many_patterns(spark, monkeypatch):
    """Parts of the patterns, repeated texts, and what regexes need."""
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    texts, patterns = [word(rnd.randint(0, 40)) for _ in range(300)] * 2, [word(rnd.randint(1, 4)) for _ in range(200)]
    frames = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    for size in (1 << 20, 500):
        monkeypatch.setattr(contain, "PART_BYTES", size)
        got = contain.with_patterns(frames[0], "t", frames[1]).collect()
        assert {r["i"]: sorted(r["held"]) for r in got} == {i: sorted({p for p in patterns if p in t}) for i, t in enumerate(texts)}
    assert {r["pattern"] for r in contain.loose_patterns(spark.createDataFrame([(p,) for p in ["a*", r"\d+", ".", "(a|b)?", "ab|c", "[xy]z", "(ab)+c?", "(", "a(?!b)", "(?i)q1", "(?i)q", "x{0}", "(?=ab)."]], "pattern string")).collect()} == {"a*", r"\d+", ".", "(a|b)?", "(?i)q", "x{0}"}
    assert contain.plan("fo[ox](bar|baz+)?qu.x") == ("and", (("or", ("foo", "fox")), "qu", "x"))
    assert contain.plan("ab^cd") == "abcd" and contain.plan("(ab|cd)e") == ("and", (("or", ("ab", "cd")), "e")) and contain.plan("a(") == "a("


def test_regex_plans_miss_nothing():
    """Random regexes over random texts: what the plan lets through holds every match."""
    rnd = random.Random(11)
    atom = lambda d: rnd.choice(["a", "b", "ab", "[ab]", ".", r"\w", "^", "$", r"\b", "(?:%s)" % regex(d - 1), "(%s)" % regex(d - 1), "(?=%s)" % regex(d - 1), "(?!%s)" % regex(d - 1), "(?i:%s)" % regex(d - 1)]) if d else rnd.choice("abc")
    regex = lambda d: "|".join("".join(atom(d) + rnd.choice(["", "", "", "*", "+?", "?", "{2}"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.choice([1, 1, 2])))
    seen = 0
    for _ in range(3000):
        p, t = regex(2), "".join(rnd.choice("abcAB ") for _ in range(rnd.randint(0, 8)))
        try:
            r = re.compile(p)
        except re.error:
            continue
        if r.search(t):
            seen += 1
            assert contain.holds(contain.plan(p), {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}), (p, t)
    assert seen > 500


def test_chunks(spark):
    files = {"a": "one\ntwo three\n\nfour", "b": "", "c": "x" * 47, "d": "12345678\n", "e": "1234567\n", "f": "\n\n\n\n\n\n\n\n\n"}
    lines = spark.createDataFrame([(f, i, x) for f, t in files.items() for i, x in enumerate(t.split("\n"))], "file string, line_no int, line string")
    got = {(r["file"], r["chunk_no"]): r["chunk"] for r in enrich.prepare_chunks(lines, 2).collect()}
    assert got == {(f, i // 8): t[i : i + 8] for f, t in files.items() for i in range(0, max(1, len(t)), 8)}


def test_fuzzy_cascade(spark):
    """Every message against every name in plain Python, with the same gate, thresholds and limits."""
    names = ["voice-fnol-poc", "voice-agent", "axios", "axios-client", "lexi", "tool", "deploy-pipeline", "pipeline", "agent-memory-store", "memory"]
    texts = ["voice fnol poc status please", "how is the axios client doing", "deploy pipelines are red again", "agent memory store and memory", "the tool broke", "nothing at all here", "pipelin deploy-pipelines", "voice agents voice-fnol-poc"]
    graph = Graph(spark.createDataFrame([(i, n, "tool", "", None, None, None) for i, n in enumerate(names)], E), spark.createDataFrame([], "source_id long, target_id long, relation string, weight double, created date"), spark.createDataFrame([], "entity_id long, key string, value string, updated date"))
    messages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session_id long, turn long, text string")
    parts = {r["name"]: set(r["p"]) for r in graph.entities.select("name", name_parts(F.col("name")).alias("p")).collect()}
    want = set()
    for m in messages.select("turn", "text", content_words(F.col("text")).alias("w"), query_tokens(F.col("text")).alias("q")).collect():
        gated = [n for n in names if (hit := parts[n] & set(m["w"])) and hit != {"tool"}]
        clean = re.sub(r"[^a-z0-9\s-]", " ", m["text"].lower()).strip()
        full = sorted((-token_set_ratio(clean, n), n) for n in gated if token_set_ratio(clean, n) >= 80)[:3]
        want |= {(m["turn"], n, "query", "") for _, n in full}
        for word in set(m["q"]):
            if len(word) >= 6:
                near = sorted((-partial_ratio(word, n), n) for n in gated if partial_ratio(word, n) >= 95)[:2]
                want |= {(m["turn"], n, "word", word) for _, n in near}
    got = {(r["turn"], r["name"], r["kind"], r["word"]) for r in recall.match_fuzzy(graph, messages).collect()}
    assert got == want and any(k == "query" for _, _, k, _ in want) and any(k == "word" for _, _, k, _ in want)
