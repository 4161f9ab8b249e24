"""Session queries read the documents' texts."""

import pytest

from graphloom.operators import enrich
from graphloom.plans import sessions

LONG = "/workspaces/coding/early " + "word " * 12_000 + "\nnpm install late-pkg\n## Research: Late Topic\n**Depth:** Deep Dive | x\n"
TEXTS = [
    "see /workspaces/coding/told/a\nthen git checkout -b feature/x and npm add left-pad ok\nError: the first failure of the text\nerror: the second failure of the text\nERROR: the third failure of the text",
    "## Investigation: Own Topic\n**Framework:** Broad\n",
    LONG,
    None,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sessions"))
    spark.createDataFrame([(i + 3, t, "en", "web") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def test_extractors_read_texts(spark, folder):
    run = lambda name, *cols: {tuple(r[c] for c in cols) for r in sessions.QUERIES[name](spark, folder).collect()}
    every = lambda x: {(i, x) for i in range(3, 7)}
    assert run("i1_extract_projects", "session_id", "project") == every("web") | {(3, "told"), (5, "early")}
    assert run("i2_extract_git_branches", "session_id", "branch") == every("en/b1") | {(3, "feature/x")}
    assert run("i3_extract_packages", "session_id", "package") == every("pkg-en") | {(3, "left-pad"), (5, "late-pkg")}
    assert run("i4_extract_errors", "session_id", "pos", "error") == {(3, i, f"the {x} failure of the text") for i, x in enumerate(["first", "second", "third"])} | {(i, 0, f"the thing number {i} has gone wrong") for i in (4, 5, 6)}
    assert run("i5_extract_research", "session_id", "topic") == every("Topic en") | every("Depth web") | {(4, "Own Topic"), (5, "Late Topic")}
    assert {("3", "told"), ("3", "left-pad"), ("5", "early"), ("5", "late-pkg"), ("6", "web")} <= run("j3_extract_candidates", "source_file", "name")


def test_tail_of_long_sessions(spark, folder):
    entities, _, _ = enrich.session_deltas(sessions._sessions(spark, folder).where("session_id <> 3"), "2024-01-31")
    names = {r["name"] for r in entities.collect()}
    assert names == {"web", "pkg-en", "research-2024-01-31-topic-en", "research-2024-01-31-depth-web", "research-2024-01-31-own-topic"}
    longer = sessions._sessions(spark, folder).where("session_id = 5").selectExpr("session_id", "3 AS user_turns", "text")
    names = {r["name"] for r in enrich.session_deltas(longer, "2024-01-31")[0].collect()}
    assert {"late-pkg", "web"} <= names and "early" not in names
