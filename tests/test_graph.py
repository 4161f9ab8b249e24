import random

import pytest

from graphloom.model import Graph, read_version, write_version
from graphloom.operators import index, lessons, mutate, query, recall
from graphloom.operators.fuzzy import partial_ratio, ratio, token_set_ratio

E = "id long, name string, type string, description string, created date, updated date, last_referenced timestamp"
R = "source_id long, target_id long, relation string, weight double, created date"
P = "entity_id long, key string, value string, updated date"


@pytest.fixture(scope="module")
def graph(spark):
    names = ["voice-fnol-poc", "axios", "lexi", "lonely", "other"]
    e = spark.createDataFrame([(i, n, "tool" if i < 3 else "lesson", f"about {n}", None, None, None) for i, n in enumerate(names)], E)
    r = spark.createDataFrame([(0, 1, "uses", 1.0, None), (1, 2, "part-of", 0.3, None), (0, 2, "part-of", 0.7, None)], R)
    p = spark.createDataFrame([(4, "status", "obsolete", None), (3, "trigger-tool", '["npm install", "x"]', None), (3, "trigger-error", '["bad (", "fail.*now"]', None), (4, "trigger-tool", "{broken", None)], P)
    return Graph(e, r, p)


def _messages(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session_id long, turn long, text string")


def test_recall_and_obsolete(spark, graph):
    m = _messages(spark, "please explain voice-fnol-poc again", "and other things")
    found = {(r["turn"], r["name"]) for r in recall.recall_match(graph, m).collect()}
    assert (0, "voice-fnol-poc") in found and (1, "other") in found
    names = {r["name"] for r in recall.visible(graph, recall.recall_match(graph, m)).collect()}
    assert "other" not in names
    assert "other" in {r["name"] for r in recall.visible(graph, recall.recall_match(graph, m), True).collect()}


def test_session_dedup(spark, graph):
    m = _messages(spark, "about axios please", "about axios once more", "what is axios?", "axios and lexi both")
    got = [(r["turn"], r["name"], r["first_fire"]) for r in recall.session_dedup(graph, recall.match_exact(graph, m).selectExpr("session_id", "turn", "name", "1 AS rank"), m).orderBy("turn", "rank").collect()]
    assert got == [(0, "axios", True), (2, "axios", False), (3, "lexi", False)]


def test_tokenizers(graph):
    plain = {r["token"] for r in index.postings(graph).where("entity_id = 0 AND col = 'name'").collect()}
    whole = {r["token"] for r in index.postings(graph, index.HYPHENS).where("entity_id = 0 AND col = 'name'").collect()}
    assert plain == {"voice", "fnol", "poc"} and whole == {"voice-fnol-poc"}


def test_upsert_is_idempotent(spark, graph):
    c = spark.createDataFrame([("New_Thing", "t", "one"), ("axios", "t", "two")], "name string, type string, description string")
    once = mutate.upsert_entities(graph, c, "2024-01-31")
    twice = mutate.upsert_entities(once, c, "2024-01-31")
    rows = lambda g: sorted((r["name"], r["type"], r["description"]) for r in g.entities.collect())
    assert rows(once) == rows(twice) and ("new-thing", "t", "one") in rows(once) and ("axios", "t", "two") in rows(once)
    assert once.entities.select("id").distinct().count() == once.entities.count()


def test_merge_and_delete(spark, graph):
    g = mutate.merge_entities(graph, spark.createDataFrame([("axios", "lexi")], "source string, target string"))
    assert {(r["source_id"], r["target_id"], r["relation"], r["weight"]) for r in g.relationships.collect()} == {(0, 2, "uses", 1.0), (0, 2, "part-of", 0.7), (2, 2, "part-of", 0.3)}
    g = mutate.delete_entities(graph, spark.createDataFrame([("lexi",)], "name string"))
    assert g.relationships.count() == 1 and mutate.graph_integrity(g).count() == 0


def test_paths(spark, graph):
    pairs = spark.createDataFrame([(2, 0), (0, 3)], "a long, b long")
    got = query.shortest_path(graph, pairs).collect()
    assert [(r["a"], r["b"], r["length"], r["path"]) for r in got] == [(2, 0, 1, "lexi -[~part-of]-> voice-fnol-poc")]
    seen, edges = query.traverse(graph, spark.createDataFrame([(3,), (1,)], "start long"), 0)
    assert seen.count() == 2 and edges.count() == 2


def test_long_paths(spark):
    e = spark.createDataFrame([(i, f"n{i:02}", "tool", None, None, None, None) for i in range(14)], E)
    r = spark.createDataFrame([(i, i + 1, "next", 1.0, None) for i in range(10)] + [(11, 12, "next", 1.0, None)], R)
    chain = Graph(e, r, spark.createDataFrame([], P))
    pairs = spark.createDataFrame([(0, 5), (10, 0), (0, 11), (3, 3), (13, 0)], "a long, b long")
    got = {(r["a"], r["b"]): (r["length"], r["path"]) for r in query.shortest_path(chain, pairs).collect()}
    assert got == {
        (0, 5): (5, "n00" + "".join(f" -[next]-> n{i:02}" for i in range(1, 6))),
        (10, 0): (10, "n10" + "".join(f" -[~next]-> n{i:02}" for i in range(9, -1, -1))),
        (3, 3): (0, "n03"),
    }
    assert {(r["a"], r["b"]) for r in query.shortest_path(chain, pairs, 5).collect()} == {(0, 5), (3, 3)}


def test_paths_are_the_smallest(spark):
    """Every pair of a random graph, against a search in plain Python; with and without spread hubs."""
    rnd = random.Random(2)
    n = 40
    e = spark.createDataFrame([(i, f"n{(i * 17) % n:02}", "tool", None, None, None, None) for i in range(n)], E)
    edges = sorted({(rnd.randrange(n), rnd.choice([0, 1, rnd.randrange(n - 4)]), rnd.choice("xyz")) for _ in range(52)})
    g = Graph(e, spark.createDataFrame([(a, b, r, 1.0, None) for a, b, r in edges], R), spark.createDataFrame([], P))
    label = {}
    for a, b, r in edges:
        for x, y, l in ((a, b, r), (b, a, "~" + r)):
            if x != y:
                label[x, y] = min(label.get((x, y), (True, "~~")), (l[0] == "~", l))
    near = {x: sorted({y for a, y in label if a == x}, key=lambda y: (y * 17) % n) for x in range(n)}
    name = lambda i: f"n{(i * 17) % n:02}"

    def smallest(a, b):
        level, paths = {a: 0}, [[a]]
        while paths:
            hits = [p for p in paths if p[-1] == b]
            if hits:
                return min(hits, key=lambda p: [name(i) for i in p])
            paths = [[*p, y] for p in paths for y in near[p[-1]] if level.setdefault(y, len(p)) == len(p)]
        return None

    some = [(a, b) for a in range(n) for b in range(0, n, 3)]
    want = {}
    for a, b in some:
        if (p := smallest(a, b)) is not None:
            want[a, b] = (len(p) - 1, name(a) + "".join(f" -[{label[x, y][1]}]-> {name(y)}" for x, y in zip(p, p[1:])))
    pairs = spark.createDataFrame(some, "a long, b long")
    assert {(r["a"], r["b"]): (r["length"], r["path"]) for r in query.shortest_path(g, pairs).collect()} == want
    assert max(x for x, _ in want.values()) >= 4 and len(want) < len(some)
    steps = query.Steps(query.adjacency(g).select("node", "next").distinct(), hub=3)
    assert steps.hubs.count() > 0 and steps.steps.select("salt").distinct().count() > 2
    assert sorted(map(tuple, steps.ahead(steps.steps.select("node").distinct()).where("node <> next").select("node", "next").collect())) == sorted(label)


def test_first_edges(spark, graph):
    e = spark.createDataFrame([(i, f"n{i:03}", "tool", "x", None, None, None) for i in range(300)], E)
    r = [(0, i, f"r{i % 7}", 1.0, None) for i in range(300)] + [(i, 0, "r0", 1.0, None) for i in range(5, 50)]
    g = Graph(e, spark.createDataFrame(r, R), spark.createDataFrame([], P))
    got = recall.first_edges(recall.recall_edges(g), spark.createDataFrame([(0,), (5,)], "me long")).collect()
    rows = [(rel, f"n{a:03}", f"n{b:03}") for a, b, rel, *_ in r]
    for me in (0, 5):
        own = sorted(x for x in rows if f"n{me:03}" in x[1:])[:6]
        assert [(x["relation"], x["source"], x["target"]) for x in sorted(got, key=lambda x: x["r"]) if x["me"] == me] == own


def test_lessons(spark, graph):
    t = lessons.trigger_table(graph)
    e = spark.createDataFrame([(1, 7, 1, "npm install axios", "it will fail right now"), (2, 7, 2, "npm install x", "bad ( thing")], "event_id long, session_id long, ts long, command string, output string").selectExpr("event_id", "session_id", "timestamp_seconds(ts) AS ts", "command", "output")
    assert [(r["event_id"], r["pattern"]) for r in lessons.match_tool(e, t).orderBy("event_id").collect()] == [(1, "npm install"), (2, "npm install")]
    assert {(r["event_id"], r["pattern"]) for r in lessons.match_error(e, t).collect()} == {(1, "fail.*now"), (2, "bad (")}
    assert lessons.activate_lessons(lessons.match_tool(e, t)).count() == 1


def test_ratios():
    assert ratio("abc", "abc") == 100.0 and ratio("abcd", "abxd") == 75.0
    assert partial_ratio("axios", "the axios attack") == 100.0
    assert token_set_ratio("b a c", "a b") == 100.0 and token_set_ratio("", "a") == 0.0


def test_versions(spark, graph, tmp_path):
    write_version(graph, str(tmp_path), 1)
    assert read_version(spark, str(tmp_path), 1).entities.count() == 5
