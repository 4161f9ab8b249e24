"""Packing, encoding, scoring, classifiers and search against brute force or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import katz, language, nearest, packing, piece_codec, toxicity

D = "/root/testdata/sf0.01"
TEXTS = ["", None, "Hello  world", "  \n", "café ▁x <|endoftext|> it's", "a" * 3000, "word " * 6000, "Hello  world", "日本 123\n\n x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")


def test_plan_uses_everything_up():
    rnd = random.Random(2)
    h = Counter(rnd.randint(1, 4096) if rnd.random() < 0.7 else 5 for _ in range(3000))
    used = Counter()
    for items, bins in packing.plan(dict(h)):
        assert sum(n * c for n, c in items) <= 4096
        for n, c in items:
            used[n] += c * bins
    assert used == h


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, want = Tokenizer.from_file(path), {}
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[i, p] = (a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))
    got = packing.pack_documents(docs, path).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096


def test_pieces(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in piece_codec.encode_digests(docs, path).collect():
        ids = model.encode(TEXTS[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_pieces_fuzz():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, codec, rnd = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path), random.Random(1)
    texts = ["".join(rnd.choice(" " * 6 + "abcdeothinrs▁\n\té日\U0001f64212<s>") for _ in range(rnd.randint(0, 50))) for _ in range(2000)]
    for t, (ids, text) in zip(texts, codec.encode_decode([t.encode() for t in texts])):
        want = model.encode(t)
        assert ids.decode() == ",".join(map(str, want)) and text.decode() == model.decode(want)


def test_katz(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["a", "B", "b", "c", "dd", f"r{rnd.randint(0, 60)}"]) for _ in range(rnd.randint(0, 40)))) for i in range(120)] + [(500, None)]
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    uni, bi, hist = Counter(), Counter(), Counter()
    for i, w in toks.items():
        if not held[i]:
            uni.update(w)
            for a, b in zip(["<s>", *w], w):
                bi[a, b] += 1
                hist[a] += 1
    n, v = sum(uni.values()), len(uni)

    def left(c):
        g = katz.good_turing(np.array([sum(x == r for x in c.values()) for r in range(1, 7)], float))
        return lambda k: g[k - 1] if k <= 5 else k - 0.5

    d1, d2 = left(uni), left(bi)
    rest = 1 - sum(map(d1, uni.values())) / n
    p = lambda w: d1(uni[w]) / n if uni[w] else rest
    seen, other = defaultdict(float), defaultdict(float)
    for (a, b), c in bi.items():
        seen[a] += d2(c) / hist[a]
        other[a] += p(b)
    share = lambda a, b: d2(bi[a, b]) / hist[a] if bi[a, b] else (1 - seen[a]) / (1 - other[a]) * p(b) if hist[a] else p(b)
    for h in list(hist)[:5]:
        assert abs(sum(share(h, w) for w in uni) + (1 - seen[h]) / (1 - other[h]) * rest - 1) < 1e-9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in katz.katz_scores(df, block_bytes=2000).collect():
        w = toks[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(uni[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-9
        assert abs(r["score"] - sum(math.log10(share(a, b)) for a, b in zip(["<s>", *w], w))) < 1e-8


def test_chained_posteriors_are_exact():
    rng = np.random.default_rng(0)
    e, a, cuts = rng.normal(size=(700, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 5, 400, 401, 700])
    p = language.posteriors(e, cuts, a)
    for i, j in zip(cuts[:-1], cuts[1:]):
        if j > i:
            g, _ = language.forward_backward(np.exp(e[i:j])[None], np.exp(a), np.full((1, 3), 1 / 3) @ np.exp(a), np.ones((1, 3)))
            assert np.allclose(g[0], p[i:j])


def test_language(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = docs.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars").unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "'12 !?' AS text", "lang", "source", "n_chars"))
    got = language.identify(docs.unionByName(extra), sample=200).select("doc_id", "held_out", "lang_pred", "score").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (None, -1))
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_toxicity_held_out(spark):
    """Learned from four fifths of the labels, judged on the others; clean rows stay clean."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = "pmod(crc32(CAST(doc_id AS STRING)), 5) = 0"
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels.where(f"NOT {held}")).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.where(held).collect()}
    assert np.mean([got[i] for i, t in truth.items() if t]) > 0.85 and np.mean([got[i] for i, t in truth.items() if not t]) < 0.005


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count()
    assert np.mean([got[i] for i, t in truth.items() if t]) > 0.9 and not any(got[i] for i, t in truth.items() if not t)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(docs.limit(5), labels.limit(0)).where("toxic").count() == 0


def test_toxicity_learns_from_few(spark):
    """A small table neither turns the model into a constant nor flags clean rows."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sum(got[i] for i, t in truth.items() if t) >= 5 and not any(got[i] for i, t in truth.items() if not t)


def test_ordinal_likelihood():
    """Against a brute-force likelihood and its differences; fitted thresholds are in order."""
    rng = np.random.default_rng(3)
    n, m = 300, 4
    hit = rng.random((n, m)) < 0.4
    grade = np.clip((hit @ np.array([2.0, 1.0, -1.0, 0.0]) + rng.logistic(size=n) * 0.5).round(), 0, 3).astype(int)
    row, col = np.nonzero(hit)

    def brute(w, cut):
        x = hit @ w
        above = np.column_stack([np.ones(n), *[1 / (1 + np.exp(c - x)) for c in cut], np.zeros(n)])
        return np.log(above[np.arange(n), grade] - above[np.arange(n), grade + 1]).sum()

    w, cut, step = rng.normal(size=m), np.array([0.0, 1.0, 2.5]), 1e-5
    mean, by_score, by_cut = toxicity.likelihood(grade, np.bincount(row, w[col], n), cut)
    assert abs(mean * n - brute(w, cut)) < 1e-6
    assert np.allclose(np.bincount(col, by_score[row], m), [(brute(w + step * e, cut) - brute(w - step * e, cut)) / (2 * step) for e in np.eye(m)], atol=1e-3)
    assert np.allclose(by_cut, [(brute(w, cut + step * e) - brute(w, cut - step * e)) / (2 * step) for e in np.eye(3)], atol=1e-3)
    w, cut = toxicity.fit(grade, row, col, m)
    assert w[0] > w[1] > w[2] and (np.diff(cut) > 0).all() and brute(w, cut) > brute(w + 0.2, cut)


def brute_nearest(rows, k=10, every=100):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            for i, v in good:
                if i != q and len(v) == len(x):
                    d = math.dist(x, v)
                    out.setdefault(q, {})[i] = min(d, out.get(q, {}).get(i, d))
    return {q: sorted(((d, i) for i, d in near.items()))[:k] for q, near in out.items()}


def test_nearest(spark, monkeypatch):
    """All cells visited: exactly what brute force finds, with ties, repeated ids and vectors of other lengths."""
    monkeypatch.setattr(nearest, "needed_fraction", lambda *a: 1.0)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1000)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (None, [1.0] * 8), (7, [1.0] * 3), (100, [2.0] * 3), (8, [0.5] * 8), (300, [0.4] * 8)] + [(3000 + i, [1.0] * 8) for i in range(12)]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, a long")
    got = {}
    for r in nearest.nearest(df, centroids=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute_nearest(rows)
    assert {q: [i for _, i in near] for q, near in got.items()} == {q: [i for _, i in near] for q, near in want.items()}
    assert all(np.allclose([d for d, _ in near], [d for d, _ in want[q]], atol=1e-12) for q, near in got.items())
    assert nearest.nearest(df.limit(0)).count() == 0


def test_nearest_among_repeated_rows(spark):
    """Every row forty times and ids with several vectors: ten different ids all the same; far from the origin too."""
    rng = np.random.default_rng(8)
    for offset in (0.0, 1e6):
        own = {i: (rng.normal(size=6) + offset).tolist() for i in range(0, 3000, 100)}
        rows = [(i, v) for i, v in own.items() for _ in range(40)] + [(i, (rng.normal(size=6) + offset).tolist()) for i in (100, 100, 250, 250)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = {}
        for r in nearest.nearest(df, every=1000, centroids=4).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert set(got) == {0, 1000, 2000}
        for q, ids in got.items():
            best = {}
            for i, v in rows:
                if i != q:
                    d = float(np.sqrt(((np.array(v) - np.array(own[q])) ** 2).sum()))
                    best[i] = min(best.get(i, d), d)
            assert len(set(ids)) == 10 and len(set(ids) & set(sorted(best, key=lambda i: (best[i], i))[:10])) >= 9


def recall(spark, rows):
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len({i for _, i in near} & got[q]) / len(near) for q, near in brute_nearest(rows).items()])


def test_nearest_recall(spark):
    """The default setting on the driver's vectors, and on clusters."""
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert recall(spark, vectors) >= 0.9
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 5
    assert recall(spark, [(i, (centres[i % 40] + rng.normal(size=16) * 0.3).tolist()) for i in range(2500)]) >= 0.9


def test_clusters_need_little():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16)) * 5
    x = np.array([centres[i % 60] + rng.normal(size=16) * 0.2 for i in range(3000)])
    left, right = nearest.codebook(x[:, :8], 32), nearest.codebook(x[:, 8:], 32)
    assert nearest.needed_fraction(x, left, right, 10, 0.97) < 0.3


def test_rare_language(spark):
    """One document in 2,500 is of another language, and is found."""
    rnd = random.Random(1)
    en, de = "the and of to in that was his with for had she you but her".split(), "der und die nicht ich sie mit auf ein den haben wir nur auch nach".split()
    text = lambda words, n: " ".join(rnd.choices(words, k=n))
    rows = [(i, text(en, 12), "en") for i in range(20_000)] + [(30_000 + i, text(de, 12), "de") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang"]: r["count"] for r in language.chosen(df, 800, 50).groupBy("lang").count().collect()} == {"en": 400, "de": 8}
    found = {r["doc_id"] for r in language.identify(df).where("lang_pred = 'de'").collect()}
    assert found == {30_000 + i for i in range(8)}


def test_words_without_letters(spark):
    df = spark.createDataFrame([(1, "² ½ ①", "en"), (2, "the cat and the dog " * 30, "en"), (3, "der hund und die katze " * 30, "de"), (4, "²a", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, folds=1_000_000).collect()}
    assert got[1] == "und" and got[4] != "und" and got[2] == "en" and got[3] == "de"


def test_packing_is_tight(spark):
    """No more sequences than the tokens need and one in fifty."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).selectExpr("count(DISTINCT sequence_id) AS n", "ceil(sum(length) / 4096) AS least").first()
    assert got["least"] <= got["n"] <= got["least"] * 1.02 + 1


def test_encoders_on_odd_texts():
    """Words and marks in every combination, and text without spaces, against the libraries."""
    import sentencepiece

    rnd, encoder = random.Random(7), packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    parts = ["a", "B", "é", "É", "ß", ".", ",", "!", "'", "'s", "23", " ", "  ", "\n", "<|endoftext|>", "…", "日", "\u0301", "x", "-", ";", ")", "İ", "\x1c", "\x85", "×"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", "日本" * 3000]
    assert encoder.by_words
    for k in range(0, len(texts), 500):
        ids, cuts = encoder.encode([t.encode() for t in texts[k : k + 500]], 1)
        for t, x, y in zip(texts[k : k + 500], cuts[:-1], cuts[1:]):
            assert ids[x:y].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, codec = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path)
    long = ["日本語のテキスト" * 500, "aab" * 700 + "日" * 300, "a1-b2_" * 400 + " x"]
    for t, (ids, text) in zip(long, codec.encode_decode([t.encode() for t in long])):
        assert ids.decode() == ",".join(map(str, model.encode(t))) and text.decode() == t


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, _id long")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for out in (
        toxicity.toxicity(none, labels), toxicity.drop_toxic(none, labels), language.identify(none), katz.katz_scores(none),
        packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")), piece_codec.encode_digests(none, public_tokenizers.path("piece_bpe_32k.model")),
    ):
        assert out.count() == 0


def test_null_long_and_repeated_rows(spark):
    """Nulls in any column, a very long text and the same row twice: a row each, repeated rows alike; other columns don't matter."""
    long = "word trash " * 60_000
    rows = [(1, None, "en", 5), (1, None, "en", 5), (None, "a b", None, None), (2, long, "en", 1), (3, "fine words here", "en", 2), (3, "fine words here", "en", 2), (4, "trash scum", "de", 3), (5, "", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (9, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    for out in (
        toxicity.toxicity(df, labels), language.identify(df), katz.katz_scores(df),
        packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json")).where("piece = 0").drop("sequence_id", "offset"), piece_codec.encode_digests(df, public_tokenizers.path("piece_bpe_32k.model")),
    ):
        got = [tuple(map(str, r)) for r in out.collect()]
        assert sorted(g[0] for g in got) == sorted(str(r[0]) for r in rows)
        for i in ("1", "3"):
            assert len({g for g in got if g[0] == i}) == 1
    assert toxicity.drop_toxic(df, labels).columns == df.columns
