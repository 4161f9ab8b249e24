"""Ranked search, whitening and token counts against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import ranked_search as R
from graphloom.llm import token_counts as T
from graphloom.llm import whitening as W

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def search(spark, docs, items, k=50, **kw):
    d = frame(spark, [(i, t, "x") for i, t in docs], "doc_id long, text string, term string").repartition(3)
    q = frame(spark, [(i, t, 1) for i, t in items], "item_id long, text string, score int")
    return sorted(map(tuple, R.ranked_search(d, q, k, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranked_search(spark):
    rnd = random.Random(5)
    words = ["the"] * 60 + ["of"] * 25 + [f"w{int(rnd.paretovariate(0.8)) % 400}" for _ in range(200)] + ["Café", "l'été", "İx", "x_y"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    docs = [(i, text(rnd.choice([3, 20, 60, 300]))) for i in range(900)]
    docs += [(900 + i, docs[i][1]) for i in range(100)] + [(5, docs[5][1]), (5, "the of w1"), (None, docs[7][1]), (None, None), (2000, ""), (2001, "?! -- \n"), (2002, "THE the " * 30_000 + "w1")]
    items = [(i, text(12)) for i in range(20)] + [(20, "the"), (21, "The of THE"), (22, None), (23, "nowhere"), (24, "w1 w2"), (24, "w3 w2"), (None, "w1 café")]
    want = ranked(docs, items, 10)
    assert search(spark, docs, items, 10, shard_bytes=20_000) == want
    assert search(spark, docs, items, 10, shard_bytes=1 << 30, items_a_block=7) == want


def test_ranked_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")]) == []
    assert search(spark, [(1, "a")], []) == []
    assert search(spark, [(1, None), (2, " ")], [(1, "a")]) == []
    assert search(spark, [(1, "a")], [(1, "a")]) == ranked([(1, "a")], [(1, "a")], 50)


def test_blocks_are_skipped():
    """Most blocks of common words stay packed, and the result is that of a search that skips nothing."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(["the", "of", "and"], k=rnd.randint(20, 400)) + rnd.choices([f"r{i}" for i in range(3000)], k=4)).encode() for _ in range(6000)]
    texts[4000] = b"the r1 r2 r1 r2"
    rows = R.shard_rows(0, list(range(len(texts))), texts).to_pylist()
    docs = next((r["heads"], r["body"]) for r in rows if not r["term"])
    terms, at, doc, _, lengths = R.postings(texts)
    df = dict(zip(terms, np.diff(at).tolist(), strict=True))
    n, total = len(texts), int(lengths.sum())
    shard = R.Shard(docs, {r["term"]: (r["heads"], r["body"]) for r in rows if r["term"] in (b"the", b"of", b"and", b"r1", b"r2")}, n, total)
    ask = [(t, R.weight(n, df[t])) for t in (b"the", b"of", b"and", b"r1", b"r2")]
    found, score = shard.best(ask, 3, 0)
    whole = np.zeros(n, np.int64)
    for t, w in ask:
        d, gain = R.List(shard.lists[t].heads.tobytes(), shard.lists[t].body, shard.lists[t].m, n, total).whole()
        whole[d] += w * gain
    order = np.lexsort((np.arange(n), -whole))[:3]
    assert found.tolist() == order.tolist() and score.tolist() == whole[order].tolist()
    common = [shard.lists[t] for t in (b"the", b"of", b"and")]
    assert sum(len(x.read) for x in common) < 0.3 * sum(len(x.heads) for x in common)


def test_words_with_one_hash(monkeypatch):
    """Words that collide are told by their bytes."""
    true = R.hash_words

    def weak(buf, fold):
        s, e, h = true(buf, fold)
        return s, e, h % np.uint64(3)

    texts = [b"a b c d abcdefghij abcdefghiX", b"a a abcdefghij q"]
    want = sorted(zip(R.postings(texts)[0], np.diff(R.postings(texts)[1]).tolist(), strict=True))
    monkeypatch.setattr(R, "hash_words", weak)
    got = R.postings(texts)
    assert sorted(zip(got[0], np.diff(got[1]).tolist(), strict=True)) == want


def whitened(spark, vectors, **kw):
    df = frame(spark, [(i, v, 2) for i, v in vectors], "vec_id long, embedding array<float>, component int").repartition(3)
    return W.whiten(df, **kw).collect()


def test_whitening(spark):
    rnd = np.random.default_rng(3)
    x = (rnd.normal(size=(300, 12)) @ rnd.normal(size=(12, 12))).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[0].tolist()), (0, x[1].tolist()), (None, x[2].tolist()), (401, [0.0] * 12)]
    bad = [(500, None), (501, [1.0] * 11 + [None]), (502, [float("nan")] + [1.0] * 11), (503, [float("inf")] * 12), (504, [])]
    got = whitened(spark, good + bad, most=5)
    ints = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(ints, axis=0).astype(object)
    n, s = len(fit), fit.sum(0)
    z = ((fit * n - s) / n).astype(float)
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:5], u[:, ::-1][:, :5]
    assert len(got) == 5 * len(good) and {r["n"] for r in got} == {n}
    want = sorted((-1 if i is None else i, int(((row.astype(object) * n - s) ** 2).sum()), np.abs(((row.astype(object) * n - s) / n).astype(float) @ u / np.sqrt(e)).round(6).tolist()) for (i, _), row in zip(good, ints, strict=True))
    for c in range(5):
        mine = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"], round(abs(r["whitened"]), 6)) for r in got if r["component"] == c + 1)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert np.allclose([m[2] for m in mine], [w[2][c] for w in want], atol=2e-6)
        assert math.isclose(next(r["explained"] for r in got if r["component"] == c + 1), e[c] / np.trace(z.T @ z / n), rel_tol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = whitened(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [5.0]), (5, [9.0])])
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in two) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]
    wide = whitened(spark, [(i, [x, -x]) for i, x in enumerate((1e30, -1e30, 3.0))])
    assert len(wide) == 3 and all(r["deviation"] is None or r["deviation"] < 1 << 63 for r in wide)


def test_bit_planes():
    rnd = np.random.default_rng(4)
    for bits in ([5, 0, 9, 1], [61, 3, 40, 0]):
        y = np.stack([rnd.integers(0, 1 << b, 150) if b else np.zeros(150, int) for b in bits], 1)
        got = W.weighted(W.popcounts(W.planes(y, bits)), bits)
        o = y.astype(object)
        assert {k: got.get(k, 0) for k in [(i, j) for i in range(4) for j in range(i, 4)]} == {(i, j): int((o[:, i] * o[:, j]).sum()) for i in range(4) for j in range(i, 4)}


TEXTS = ["", None, "Hello  world", "  \n", "café ▁x <|endoftext|> it's", "a" * 3000 + " b" * 50, "word " * 6000, "Hello  world", "日本 123\n\n x", "a   b　 c", "x\x1c y  \x85z  ", "tab\t\tnew\n line \r\n", " <|endoftext|><|endoftext|>", "l'été it'll 12,3  é", "​ z"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name, tmp_path):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        encode = lambda x: t.encode(x, add_special_tokens=False).ids
    docs = frame(spark, [(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, "again", 1), (None, "again", 1)], "doc_id long, text string, n_tokens int").repartition(3)
    want = sorted([(i, len((t or "").encode()), len(encode(t or ""))) for i, t in enumerate(TEXTS)] + [(3, 5, len(encode("again"))), (-1, 5, len(encode("again")))])
    cache = f"file://{tmp_path}/cache"
    for known in (False, True):
        got = T.token_counts(docs, path, cache, limit=100).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) and r["cached"] == known for r in got)


def test_cache_encodes_only_what_it_lacks(spark, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    docs = lambda texts: frame(spark, list(enumerate(texts)), "doc_id long, text string")
    version = T.tokenizer_version(path)
    made = []
    add = T.add_missing
    monkeypatch.setattr(T, "add_missing", lambda *a: made.append(add(*a)) or made[-1])
    T.token_counts(docs(["a b", "c", "a b", None]), path, cache)
    T.token_counts(docs(["c", "d e", "d e", ""]), path, cache)
    T.token_counts(docs([]), path, cache)
    assert made == [3, 1, 0] and T.stored(spark, cache, version).count() == 4
    # a cache that already holds a digest is believed: the count comes from the join, not from the text
    (spark.sql("SELECT unhex(sha2('never encoded', 256)) AS digest, 99L AS n_tokens").write.mode("append").parquet(f"{cache}/tokenizer={version}"))
    assert [r["n_tokens"] for r in T.token_counts(docs(["never encoded"]), path, cache).collect()] == [99]
    other = T.token_counts(docs(["never encoded"]), public_tokenizers.path("piece_bpe_32k.model"), cache).collect()
    assert other[0]["n_tokens"] != 99


def test_many_misses_and_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FEW_MISSES", 5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = frame(spark, [(i, "copied text" if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string").repartition(4)
    got = T.token_counts(docs, path, f"file://{tmp_path}/cache", heavy=8).collect()
    count = T.counter(path, T.tokenizer_version(path)).counts
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, count(["copied text" if i % 3 else f"text {i}"])[0]) for i in range(300)]
