from pyspark.sql import functions as F

from graphloom.functions import columns as C


def _one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first()["y"]


def test_names(spark):
    assert _one(spark, "MyHTTPServer_name--x-", C.normalize_name) == "my-http-server-name-x"
    assert _one(spark, "voice-fnol-poc", C.normalize_name) == "voice-fnol-poc"
    assert len(_one(spark, "A long Title! " * 10, C.slug_title)) == 60


def test_stems(spark):
    assert _one(spark, "queries", C.stem_variants) == ["queries", "query"]
    assert _one(spark, "class", C.stem_variants) == ["class"]
    assert _one(spark, "building", C.stem_variants) == ["building", "build"]


def test_caps(spark):
    out = _one(spark, "x" * 1300, lambda c: C.cap_with_marker(c, 800))
    assert out == "x" * 800 + "...[+500]"
    assert _one(spark, "", lambda c: C.chunk_text(c, 10)) == [""]
    assert _one(spark, "é" * 10, lambda c: C.truncate_bytes(c, 7, "|")) == "ééé|"


def test_messages(spark):
    assert _one(spark, "what is the state of voice-fnol-poc now", C.skip_reason) is None
    assert _one(spark, "look at voice-fnol-poc", C.skip_reason) is None
    assert _one(spark, "look at it right now", C.skip_reason) == "directive"
    assert _one(spark, "lgtm", C.skip_reason) == "short"
    assert _one(spark, "git status of everything", C.skip_reason) == "run"
    assert _one(spark, "tell me: why?", C.is_question)


def test_paths(spark):
    for token, ok in (("src/a.py:12", True), ("a/b.tar", True), ("f(x).py", False), ("http://a/b.md", False), ("a/.env", False), ("plain", False)):
        assert _one(spark, token, C.path_like) is ok


def test_truncate_bytes_at_every_place(spark):
    """Characters of one to four bytes, cut at every byte."""
    from graphloom.functions.columns import truncate_bytes

    texts = ["aé日😀bé", "😀😀", "ééééé", "日本語です", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(1, 18):
        got = {r["t"]: r["c"] for r in df.select("t", truncate_bytes(F.col("t"), n, "|").alias("c")).collect()}
        assert got == {t: t if len(t.encode()) <= n else t.encode()[:n].decode(errors="ignore") + "|" for t in texts}
