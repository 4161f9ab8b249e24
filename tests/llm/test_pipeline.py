"""The pipeline against its parts' definitions."""

import inspect
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from graphloom.llm import toxicity
from graphloom.llm.common import materialize
from tests.llm.test_dedup import components, without_repeats
from fractions import Fraction

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = materialize(stage(spark, before, D), f"test-{i}")
        assert after.columns == columns, name
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in after.collect()} == {c for _, c in components(rows, 5, Fraction(80, 100)).values()}
        before = after
    assert all(r["n_chars"] == len(r["text"]) for r in before.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, before, D)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def without_spans(rows, window=50):
    words, first, out = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows}, {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    for i, t in rows:
        w = words[i]
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out[i] = [x for q, x in enumerate(w) if q not in gone] if gone else t
    return out


def test_rows_and_texts_of_stages(spark):
    """Each stage's rows and texts against brute force; toxicity against its model, applied here one text at a time."""
    from tokenizers import Tokenizer

    before = spark.read.parquet(f"{D}/documents.parquet")
    model = toxicity.train(before, spark.read.parquet(f"{D}/labels.parquet"), 20_000)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = materialize(stage(spark, before, D), f"rows-{i}")
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        texts = dict(rows)
        assert len(texts) == len(rows)
        if name == "toxicity":
            cut = inspect.signature(toxicity.drop_toxic).parameters["cut"].default
            want = {d: t for d, t in rows if toxicity.severities([(t or "").encode()], model)[0] < cut}
        elif name == "line dedup":
            want = {d: x[2] for d, x in without_repeats(rows).items() if not x[1] or x[2].split()}
            assert any(x[1] for x in without_repeats(rows).values())
        elif name == "n-gram Jaccard join":
            want = {c: texts[c] for _, c in components(rows, 5, Fraction(80, 100)).values()}
        else:
            want = {d: x for d, x in without_spans(rows).items() if x or x == texts[d]}
            assert any(isinstance(x, list) for x in want.values())
        got = after.collect()
        kept = {r["doc_id"]: r["text"] for r in got}
        # where words go, the space between the others is not compared
        kept = {d: re.findall(r"[^\x20\x09-\x0D]+", t) if isinstance(want.get(d), list) else t for d, t in kept.items()}
        assert kept == want and len(got) == len(want), name
        assert all(r["n_chars"] == len(r["text"]) for r in got), name
        before = after
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in before.collect():
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], p] = (a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))
    got = corpus_pipeline.STAGES[-1][1](spark, before, D).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        assert all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:])) and sum(n for _, n in b) <= 4096


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Null and empty texts, the same row twice, clashing names and a very long text pass all stages; so does no row at all."""
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, "you trash scum", 5, "a", 0), (2, None, None, None, 1), (3, "", 0, "b", 2), (4, long, len(long), "c", 3), (5, "alone here", 10, "d", 4), (5, "alone here", 10, "d", 4), (None, "no id at all", 12, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, gone string, carried long")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, some, str(tmp_path)), "odd")
            if name != "best-fit packing":
                assert out.columns == docs.columns, name
                some = out
        kept = {r["doc_id"] for r in some.collect()}
        assert {r["doc_id"] for r in out.collect()} == kept and (kept == {2, 3, 4, 5, None} or not kept)
    assert out.count() == 0
