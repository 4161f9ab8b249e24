"""Dedup operators against brute force."""

import hashlib
import random
import re
import time
from fractions import Fraction
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import setjoin
from graphloom.llm.common import CLEANUP, Spans, hash_words, materialize, shared_dir
from graphloom.llm.exact_dedup import MisraGries, exact_dedup
from graphloom.llm.line_dedup import line_dedup, op9_line_dedup
from graphloom.llm.ngram_join import drop_near_copies, ngram_join
from graphloom.llm.setjoin import among
from graphloom.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randint(0, 30)) for _ in range(60)] for _ in range(6)]
    out = []
    for i in range(250):
        b = list(base[0] if rnd.random() < 0.5 else rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8])):
            b[rnd.randrange(len(b))] = f"x{rnd.randint(0, 40)}"
        if rnd.random() < 0.1:
            b = b[: rnd.randint(0, 8)]
        out.append((i, "\n".join(" ".join(b[j : j + 12]) for j in range(0, len(b), 12)) if rnd.random() < 0.97 else None))
    return [*out, (900, ""), (901, " \n "), (902, "é " * 4000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "digest", 7) for i, t in rows], "doc_id long, text string, id string, n long")


def test_misra_gries():
    m = MisraGries(3)
    for _ in range(10):
        m.add(["a"] * 5 + list("bcdefg"))
    assert m.counts["a"] >= 50 - 110 / 4 and len(m.counts) <= 3


@pytest.mark.parametrize("heavy", [2, 512])
def test_exact(rows, docs, heavy):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = {i: (max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows}
    assert {r[0]: tuple(r)[1:] for r in exact_dedup(docs, heavy).collect()} == want


def test_exact_repeated_rows(spark):
    got = exact_dedup(spark.createDataFrame([(1, "a"), (1, "A"), (None, "a")], "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in got) == 1 and all(r["keep_id"] == 1 and r["group_size"] == 3 for r in got)


def components(rows, k, least):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            both = len(a & sets[y])
            if both and both >= least * (len(a) + len(sets[y]) - both):
                up[root(x)] = root(y)
    best = {}
    for x, (i, _) in enumerate(rows):
        best[root(x)] = min(best.get(root(x), i), i)
    return {i: (len(sets[x]), best[root(x)]) for x, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("k, num, groups", [(3, 90, 64), (5, 80, 32)])
def test_ngram_join(rows, docs, k, num, groups):
    want = components(rows, k, Fraction(num, 100))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(docs, k, Fraction(num, 100), groups).collect()}
    assert got == want


def test_one_of_each_group_stays(rows, docs):
    want = {c for i, (n, c) in components(rows, 5, Fraction(80, 100)).items()}
    got = drop_near_copies(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want


def test_lines(rows, docs):
    lines = [(i, j, frozenset(WORD.findall(low(x)))) for i, t in sorted(rows) for j, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5]
    gone = {(i, j) for n, (i, j, s) in enumerate(lines) if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:n])}
    want = {}
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for j, x in enumerate(parts) if (i, j) not in gone]
        want[i] = (len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in line_dedup(docs, fewest=5).collect()} == want


def without_repeats(rows):
    """Brute force over all lines but blank ones: (doc_id, lines, lines gone, text that stays)."""
    lines = [(i, j, frozenset(WORD.findall(low(x)))) for i, t in sorted(rows) for j, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {(i, j) for n, (i, j, s) in enumerate(lines) if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:n])}
    kept = {i: [x for j, x in enumerate((t or "").split("\n")) if (i, j) not in gone] for i, t in rows}
    return {i: ((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept[i]), "\n".join(kept[i])) for i, t in rows}


def test_short_lines(spark, rows, tmp_path):
    menu = ["Home", "home", "Les.", "And ornd.", "ornd. And and", "a b c", "c b a", "a b d", "p q r s", "p q r s t", "q r s u", "", " "]
    short = [*rows, *((1000 + i, "\n".join(menu[i % 5 :] + menu[: i % 3])) for i in range(20))]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = without_repeats(short)
    assert want[1019][1] > 5
    assert {r[0]: tuple(r)[1:] for r in op9_line_dedup(spark, str(tmp_path)).collect()} == {i: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, (n, gone, t) in want.items()}


@pytest.mark.parametrize("window", [5, 50])
def test_spans(rows, docs, window):
    words, first, want = {i: WORD.findall(t or "") for i, t in rows}, {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in substring_dedup(docs, window).collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(none).count() == line_dedup(none).count() == substring_dedup(none).count() == ngram_join(none).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


def test_word_hashes_of_regular_words():
    """Words that collide under any polynomial hash modulo a power of two, and words that are long or alike."""
    for n in (7, 8, 9, 64, 255, 256, 257, 1024, 4096):
        x, y = thue_morse(n)
        words = [x, y, x + "a", x[:-1], x + "\0", y[::-1] + "c"]
        s, e, h = hash_words(" ".join(words).encode(), False)
        assert (e - s).tolist() == [len(w) for w in words] and len(set(h.tolist())) == len(set(words))
    spans, seen = Spans(hash_words(" ".join(thue_morse(64)[0]).encode(), False)[2]), {}
    words = thue_morse(64)[0]
    for i in range(64):
        for j in range(i + 1, 65):
            seen.setdefault(int(spans(np.array([i]), np.array([j]))[0]), set()).add(words[i:j])
    assert all(len(x) == 1 for x in seen.values())


def test_regular_words_stay_apart(spark):
    x, y = thue_morse(1024)
    rows = [(1, f"{x} one two three"), (2, f"{y} one two three"), (3, "\n".join([x, y])), (4, " ".join([x, *"abcdefgh"])), (5, " ".join([y, *"abcdefgh"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join(df).collect()} == {i: i for i, _ in rows}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup(df).collect()} == {i: x[1] for i, x in without_repeats(rows).items()}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(df, 9).collect()} == {i: 0 for i, _ in rows}


def test_clashing_columns(spark):
    """Names that the operators use inside are carried like any other."""
    names = "_id _hash _text_hash text_hash gone n_removed n_lines n_words kept_sha256 flags ask hashes id row carried component_id".split()
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c d e f\nx", "a b c d e f\ny", None, "", "a b c d e f\nx"])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3}
    for stage in (corpus_pipeline.lines, corpus_pipeline.spans):
        out = stage(spark, df, "")
        assert out.columns == df.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
    assert exact_dedup(df).count() == 5 and ngram_join(df).count() == 5


def test_repeated_rows(spark):
    rows = [(1, "one two three four five six\nlast"), (1, "one two three four five six\nlast"), (2, "one two three four five six\nother"), (None, "one two three four five six"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup(df).collect())
    assert lines == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 1)]
    spans = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup(df, 4).collect())
    assert spans == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 6)]
    assert sorted(r["component_id"] or 0 for r in ngram_join(df, 2, Fraction(60, 100)).collect()) == [0, 1, 1, 1, 1]


def test_one_large_group_of_lines(spark):
    """Lines of a few templates that share their frequent words: most are alike, some only nearly, and none is lost."""
    rnd = random.Random(12)
    lines = [f"see the annual report of the fund on page p{i} now" for i in range(500)]
    lines += [f"see the annual report of the {rnd.choice(['fund', 'bank', 'board'])} on page p{rnd.randint(0, 900)} {rnd.choice(['now', 'here', 'and there', 'or not at all'])}" for _ in range(400)]
    rnd.shuffle(lines)
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {i: x[1] for i, x in without_repeats(rows).items()}
    assert got == want and 0 < sum(1 for x in want.values() if not x) < 60


def shuffled(spark):
    """Shuffle files on disk and their sizes."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data")}


def test_written_tables_leave_no_shuffle(spark):
    before, set_before = shuffled(spark), spark.conf.get(CLEANUP, None)
    written = materialize(spark.range(50_000, numPartitions=4).repartition(3, "id"), "test-shuffled")
    end = time.time() + 20
    while (left := shuffled(spark).keys() - before.keys()) and time.time() < end:
        time.sleep(0.2)
    assert not left and written.count() == 50_000
    assert spark.conf.get(CLEANUP, None) == set_before


def test_named_classes_alone_are_shuffled(spark):
    at = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(at)
    classes = materialize(spark.range(20_000).select(F.xxhash64("id").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("prefix")), "test-classes")
    named = materialize(spark.range(0, 20_000, 1000).select(F.xxhash64("id").alias("id")), "test-named")
    spark.conf.set(at, "-1")
    try:
        before = shuffled(spark)
        found = among(classes, named)
        rows = found.collect()
        sent = sum(n for f, n in shuffled(spark).items() if f not in before)
    finally:
        spark.conf.set(at, old)
    assert sorted(rows) == sorted(classes.join(named, "id", "left_semi").collect()) and len(rows) == 20
    assert sent < 200_000  # the prefixes alone have 2.5 MB


def test_pairs_are_searched_without_the_table_of_lines(spark, docs, rows, monkeypatch):
    """While pairs are searched, prefixes and vectors are on disk once: with the classes, not with every line as well."""
    root = Path(shared_dir(spark).removeprefix("file:"))
    there, old = [], set(root.iterdir())

    def spy(df, name):
        there.append({p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - old})
        return materialize(df, name)

    monkeypatch.setattr(setjoin, "materialize", spy)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup(docs).collect()}
    assert got == {i: x[1] for i, x in without_repeats(rows).items()}
    assert there and all("line-classes" in x and "line-rows" not in x for x in there)


def test_one_large_group_of_texts(spark):
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words + [f"x{rnd.randint(0, 300)}"] + (["y"] * rnd.choice([0, 0, 1, 6])))) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: c for i, (_, c) in components(rows, 3, Fraction(90, 100)).items()}
