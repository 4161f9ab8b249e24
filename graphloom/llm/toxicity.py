"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades that share one weight vector and differ by their thresholds: P(grade > j) = s(w.x - t_j).
The grades are those of the labels' column `toxic`, 0 for clean and any number above; a table that holds 0 and 1 has two
grades and so one threshold. Features are the distinct letter-only words of a text and their leading bytes (stems). The
fit uses at most `sample` labelled documents, the first by a hash of their id; only features that go with toxic or clean
rows more than chance allows get a weight, at a false discovery rate. The output is the expected severity, the sum of the
P(grade > j); a text is toxic when that is at least `cut`.

Defined results: a null or empty text has no feature, and a text of any length has those of all its words; labels that
are null or without a document are left out, of several labels of a document the highest holds, of several texts of an id
the least is learned from; features on a tie are all taken; without toxic labels nothing is toxic; repeated rows are
scored each; an empty table gives an empty result. Other columns of the documents are carried as they are by drop_toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import binaries, distinct_sorted, documents, materialize, mix, pack, some_rows, text_batches, unpack

STEMS = (4, 5, 6)
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and stems of all texts, and where each text's begin."""
    texts = [t.translate(_LETTERS) for t in texts]
    out, counts = [], []
    for chunk in _chunks(texts):
        buf = b" ".join(chunk)
        s, e, h = common.hash_words(buf, False)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in chunk])])
        a = np.frombuffer(buf + bytes(8), np.uint8)
        cuts = np.searchsorted(s, offsets)
        rows, keys = [np.arange(len(s))], [h]
        for n in STEMS:
            long = np.flatnonzero(e - s > n)
            v = np.zeros(len(long), np.uint64)
            for k in range(n):
                v = v * np.uint64(257) + a[s[long] + k]
            rows.append(long)
            keys.append(mix(v + np.uint64(n << 56)))
        rows, keys = np.concatenate(rows), np.concatenate(keys)
        by = np.argsort(rows, kind="stable")
        out.append(keys[by])
        counts.append(np.diff(np.searchsorted(rows[by], cuts)))
    counts = np.concatenate(counts) if counts else np.zeros(0, int)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def _chunks(texts: list[bytes], limit: int = 1 << 20):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(grade, text) of at most `sample` labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("grade"))
    chosen = some_rows(known.join(docs.select("doc_id"), "doc_id", "left_semi"), sample, "doc_id")
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text"))
    return materialize(rows.select(F.greatest("grade", F.lit(0)).alias("grade"), "text"), "toxicity-sample")


def evidence(df: np.ndarray, t: np.ndarray, p: float) -> np.ndarray:
    """-log of the Chernoff bound on how likely t of df rows are toxic by chance, where a share p is."""
    q = np.clip(t / df, 1e-12, 1 - 1e-12)
    return df * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p)))


def telling(rows: DataFrame, rate: float, fewest: int, parts: int = 16) -> np.ndarray:
    """Sorted features that go with toxic rows, or with others, more than chance allows, at a false discovery rate.

    The rate follows from how many features were looked at (Benjamini and Hochberg), so it means the same for small and
    large tables. At least the `fewest` strongest are taken.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") > 0).alias("bad")).first()
    if not total["bad"] or total["bad"] == total["n"]:
        return np.zeros(0, np.uint64)
    p = total["bad"] / total["n"]

    def count(batches):
        for b in text_batches(batches):
            keys, cuts = features(binaries(b.column("text")))
            bad = b.column("grade").to_numpy() > 0
            each = [distinct_sorted(keys[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            names, number = np.unique(np.concatenate(each), return_inverse=True)
            df, t = np.bincount(number, minlength=len(names)), np.bincount(number, np.repeat(bad, [len(k) for k in each]), len(names))
            at = np.searchsorted(names >> np.uint64(60), np.arange(parts + 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([pack(names[x:y], df[x:y].astype(np.uint32), t[x:y].astype(np.uint32)) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["part", "counts"])

    def weigh(table: pa.Table) -> pa.Table:
        keys, df, t = (np.concatenate(x) for x in zip(*map(unpack, table.column("counts").to_pylist()), strict=True))
        names, number = np.unique(keys, return_inverse=True)
        return pa.table([pa.array(names.view(np.int64)), pa.array(evidence(np.bincount(number, df, len(names)), np.bincount(number, t, len(names)), p))], ["key", "told"])

    found = materialize(rows.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(weigh, "key long, told double"), "toxicity-features")
    step = found.groupBy(F.least(F.floor(F.col("told") * 100), F.lit(1_000_000)).alias("x")).count().collect()  # bounded by the steps
    edge, n = np.array(sorted((r["x"], r["count"]) for r in step), np.int64).reshape(-1, 2).T
    above = np.cumsum(n[::-1])[::-1]
    passing = np.flatnonzero(edge / 100 >= np.log(n.sum() / (rate * above)))
    least = edge[passing[0]] if len(passing) else edge[-1]
    least = min(least, edge[max(0, np.searchsorted(-above, -fewest, "right") - 1)])
    return np.sort(np.array([r["key"] for r in found.where(F.col("told") >= F.lit(float(least / 100))).select("key").collect()], np.int64).view(np.uint64))  # of the sample's features


def train(docs: DataFrame, labels: DataFrame, sample: int, rate: float = 0.05, fewest: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted feature hashes, their weights and the thresholds, one less than there are grades."""
    rows = sampled(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample)
    names = telling(rows, rate, fewest)

    def pick(batches):
        for b in text_batches(batches):
            row, col = hits(binaries(b.column("text")), names)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([pack(col[x:y].astype(np.int32)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["grade", "cols"])

    got = sorted(rows.mapInArrow(pick, "grade int, cols binary").collect(), key=lambda r: (r["grade"], bytes(r["cols"])))  # bounded by `sample`
    if not got or not got[-1]["grade"]:
        return names[:0], np.zeros(0), np.zeros(0)
    cols = [unpack(bytes(r["cols"]))[0] for r in got]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    return names, *fit(np.array([r["grade"] for r in got]), row, np.concatenate(cols), len(names))


def likelihood(grade: np.ndarray, x: np.ndarray, cut: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of the grades, and its slopes by each row's score and by each threshold (both times the rows)."""
    n, i = len(grade), np.arange(len(grade))
    above = 1 / (1 + np.exp(-np.clip(x[:, None] - cut, -30, 30)))
    edge = np.column_stack([np.ones(n), above, np.zeros(n)])
    like = np.maximum(edge[i, grade] - edge[i, grade + 1], 1e-12)
    slope = np.column_stack([np.zeros(n), above * (1 - above), np.zeros(n)])
    by_score = (slope[i, grade] - slope[i, grade + 1]) / like
    by_cut = np.array([((grade == j) * slope[:, j + 1] / like - (grade == j + 1) * slope[:, j + 1] / like).sum() for j in range(len(cut))])
    return float(np.log(like).mean()), by_score, by_cut


def fit(grade: np.ndarray, row: np.ndarray, col: np.ndarray, m: int, rounds: int = 600, rate: float = 0.1, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of m features and ascending thresholds, by Adam steps of falling size on the likelihood of the grades."""
    n = len(grade)
    w, cut = np.zeros(m), 1.0 + np.arange(grade.max())
    state = [[np.zeros(len(y)), np.zeros(len(y))] for y in (w, cut)]
    for r in range(1, rounds + 1):
        _, by_score, by_cut = likelihood(grade, np.bincount(row, w[col], n), cut)
        size = rate * min(1.0, 2 * (1 - r / rounds) + 0.02)
        for y, g, s in ((w, np.bincount(col, by_score[row], m) / n - ridge * w, state[0]), (cut, by_cut / n, state[1])):
            s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.99 * s[1] + 0.01 * g * g
            y += size * (s[0] / (1 - 0.9**r)) / (np.sqrt(s[1] / (1 - 0.99**r)) + 1e-7)
        cut[:] = np.maximum.accumulate(cut + 1e-6 * np.arange(len(cut)))
    return w, cut


def hits(texts: list[bytes], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs among the named features."""
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, cuts = features(texts)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    hit = np.flatnonzero(names[at] == keys)
    pair = distinct_sorted((np.searchsorted(cuts, hit, "right") - 1) * len(names) + at[hit])
    return pair // len(names), pair % len(names)


def severities(texts: list[bytes], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Expected severity of each text."""
    names, w, cut = model
    x = np.zeros(len(texts))
    if len(names) and texts:
        row, col = hits(texts, names)
        x = np.bincount(row, w[col], len(texts))
    return (1 / (1 + np.exp(-np.clip(x[:, None] - cut, -30, 30)))).sum(1)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5, sample: int = 20_000) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def run(batches):
        for b in text_batches(batches):
            s = severities(binaries(b.column("text")), model.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(s >= cut)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5, sample: int = 20_000) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches):
        for b in text_batches(batches):
            yield b.filter(pa.array(severities(binaries(b.column("text")), model.value) < cut))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
