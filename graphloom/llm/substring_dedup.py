"""Substring dedup over a compacted De Bruijn graph of word k-mers.

Nodes are the closed syncmers of a text's words: k-mers chosen by their own words alone, at least one in every window.
Edges are the spans between neighbouring nodes (or a text's start and end). One aggregation gives each node its first
document and whether it repeats and branches; one join brings that back to the source coordinates, with frequent nodes
broadcast. A run of repeated nodes with one way in and one way out is a compacted path: all its occurrences are alike, so
a window inside it is settled by the path's first document. Windows across a branch are settled one by one, by their own
hashes. No decision rests on one 64-bit hash: a node on a path is told by its own hash and by that of its edges, which
cover its words as well, and a window across a branch by two hashes.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged; a null text has none; a word goes when a window of `window`
words that covers it also starts in a document with a smaller doc_id; a null doc_id is neither smaller nor larger, so its
row stays whole; rows with the same id and text have the same result; windows are judged on the input, of any length; an
empty table gives an empty result. With `carry`, other columns come in one struct, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Spans, binaries, carried, discard, documents, hash_words, materialize, mix, text_batches, words_of

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
PROOF, HEAVY = 0x2545F4914F6CDD1D, 4096


def sizes(window: int) -> tuple[int, int]:
    """k and s: every `window` words hold a closed syncmer of k words with s-mers of s words."""
    s = 2 if window >= 6 else 1
    return (window + 1 + s) // 2, s


def nodes(spans: Spans, cuts: np.ndarray, window: int) -> np.ndarray:
    """Where closed syncmers start; none crosses from one text into the next."""
    k, s = sizes(window)
    n, m = len(spans.levels[0]), k - s
    if n < k:
        return np.zeros(0, np.int64)
    at = np.arange(n - s + 1)
    v = spans(at, at + s)
    least, width = v, 1
    while width < m + 1:
        step = min(width, m + 1 - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    picked = np.flatnonzero((least == v[: len(least)]) | (least == v[m : m + len(least)]))
    text = np.searchsorted(cuts, picked, "right") - 1
    return picked[picked + k <= cuts[text + 1]]


def graph_rows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, place, node, ways): a row for each node of each text; `ways` hashes the edges in and out."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in ("text_hash", "place", "node", "ways")]])
    k, _ = sizes(window)

    def run(batches):
        for b in text_batches(batches):
            h, cuts = words_of(binaries(b.column("text")), False)
            spans = Spans(h)
            p = nodes(spans, cuts, window)
            doc = np.searchsorted(cuts, p, "right") - 1
            first, last = np.diff(doc, prepend=-1) != 0, np.diff(doc, append=-1) != 0
            before = np.where(first, cuts[doc], np.roll(p, 1))
            after = np.where(last, cuts[doc + 1], np.roll(p, -1) + k)
            into, out = spans(before, p + k), spans(p, after)
            ways = mix(into + np.where(first, START, np.uint64(0))) ^ mix(out + np.where(last, END, START))
            place = np.arange(len(p)) - np.searchsorted(doc, doc)
            keep = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(keep), b.column("text_hash").take(keep), pa.array(place), pa.array(spans(p, p + k).view(np.int64)), pa.array(ways.view(np.int64))], schema.names)

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def judge(spans: Spans, a: int, b: int, p: np.ndarray, flags: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the text of words a..b with nodes at p: windows settled as repeated, windows to settle by hash, their two hashes.

    flags: 1 repeated, 2 straight (one way in, one way out), 4 an earlier document has it.
    """
    k, _ = sizes(window)
    i = np.arange(a, b - window + 1)
    lo, hi = np.searchsorted(p, i), np.searchsorted(p, i + window - k, "right")
    single = np.concatenate([[0], np.cumsum((flags & 1) == 0)])
    all_repeated = single[hi] == single[lo]
    straight = (flags & 2) != 0
    n = len(p)
    ahead = np.minimum.accumulate(np.where(straight, np.arange(n), n)[::-1])[::-1]
    ahead = np.append(ahead, n)[lo]
    idx = np.arange(n)
    bend_before = np.maximum.accumulate(np.where(straight, -1, idx))
    bend_after = np.minimum.accumulate(np.where(straight, n, idx)[::-1])[::-1]
    left = np.where(bend_before >= 0, p[bend_before], a)
    right = np.where(bend_after < n, p[np.minimum(bend_after, n - 1)] + k, b)
    v = np.minimum(ahead, n - 1)
    settled = (ahead < hi) & (left[v] <= i) & (i + window <= right[v])
    gone = i[all_repeated & settled & ((flags[v] & 4) != 0)]
    ask = i[all_repeated & ~settled]
    return gone - a, ask - a, spans(ask, ask + window), spans(ask, ask + window, PROOF)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge)[:n] > 0


def rest(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that go; where some went, one line feed or space stands for the gap."""
    s, e, _ = hash_words(text, False)
    keep = np.flatnonzero(~gone)
    if not len(keep):
        return b""
    runs = np.split(keep, np.flatnonzero(np.diff(keep) != 1) + 1)
    out = text[: e[runs[0][-1]]] if runs[0][0] == 0 else text[s[runs[0][0]] : e[runs[0][-1]]]
    for before, r in zip(runs, runs[1:], strict=False):
        gap = text[e[before[-1]] : s[r[0]]]
        out += (b"\n" if b"\n" in gap else b" ") + text[s[r[0]] : e[r[-1]]]
    return out + (text[e[-1] :] if keep[-1] == len(gone) - 1 else b"")


def with_first(rows: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """Rows with what stats(key, n, ...) says of their key, where it has the key.

    Keys with at least 1 / HEAVY of the rows counted, of which there are at most HEAVY, come by a broadcast, so that no
    task gathers the rows of a frequent passage; the others meet in a shuffle.
    """
    total = stats.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(stats.where(F.col("n") >= max(2, -(-total // HEAVY))).drop("n"))
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(*key), key, "left_anti").join(stats.drop("n"), key))


def substring_dedup(docs: DataFrame, window: int = 50, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with `carry` also the struct `carried` of those columns and the kept text."""
    docs, others = carried(docs, carry)
    doc_type = docs.schema["doc_id"].dataType
    rows = graph_rows(docs, window)
    stats = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), (F.min("ways") == F.max("ways")).alias("straight"), F.count(F.lit(1)).alias("n")).where(F.col("first") < F.col("last")).select("node", "first", "straight", "n")
    stats = materialize(stats, "substring-nodes")
    flag = F.lit(1) + F.when(F.col("straight"), 2).otherwise(0) + F.when(F.col("first") < F.col("doc_id"), 4).otherwise(0)
    flags = with_first(rows.select("doc_id", "text_hash", "place", "node"), stats, ["node"]).select("doc_id", "text_hash", (F.col("place") * 8 + flag).alias("f")).groupBy("doc_id", "text_hash").agg(F.collect_list("f").alias("flags"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", *[f.name for f in others])
    done = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    mid = T.StructType([T.StructField("doc_id", doc_type), T.StructField("text_hash", T.LongType()), *done, *others, T.StructField("text", T.StringType()), T.StructField("gone", T.ArrayType(T.IntegerType())), T.StructField("ask", T.ArrayType(T.IntegerType())), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("proofs", T.ArrayType(T.LongType()))])

    def finish(text: bytes, gone: np.ndarray | None) -> tuple[int, int, str, bytes | None]:
        words = text.split()
        cut = gone is not None and gone.any()
        kept = compress(words, (~gone).tolist()) if cut else words
        left = (rest(text, gone) if cut else text) if carry is not None else None
        return len(words), int(gone.sum()) if cut else 0, hashlib.sha256(b" ".join(kept)).hexdigest(), left

    def settle(batches):
        for b in text_batches(batches):
            texts, known = binaries(b.column("text")), b.column("flags").to_pylist()
            some = [i for i, f in enumerate(known) if f]
            h, cuts = words_of([texts[i] for i in some], False)
            spans = Spans(h)
            p = nodes(spans, cuts, window)
            ends = np.searchsorted(p, cuts)
            out = [(*finish(t, None), None, None, None, None) if not f else None for t, f in zip(texts, known, strict=True)]
            for j, i in enumerate(some):
                own = p[ends[j] : ends[j + 1]]
                bits = np.zeros(len(own), np.int64)
                f = np.array(known[i], np.int64)
                bits[f >> 3] = f & 7
                gone, ask, hashes, proofs = judge(spans, cuts[j], cuts[j + 1], own, bits, window)
                if len(ask):
                    out[i] = (None, None, None, texts[i], gone.tolist(), ask.tolist(), hashes.view(np.int64).tolist(), proofs.view(np.int64).tolist())
                else:
                    out[i] = (*finish(texts[i], covered(cuts[j + 1] - cuts[j], gone, window)), None, None, None, None)
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *cols[:3], *[b.column(f.name) for f in others], cols[3].cast(pa.string()), *cols[4:]], mid.names)

    state = materialize(texts.join(flags, ["doc_id", "text_hash"], "left").mapInArrow(settle, mid), "substring-state")
    discard(stats)
    final = ["doc_id", "n_words", "n_removed", "kept_sha256", *([*[f.name for f in others], "text"] if carry is not None else [])]
    open_rows = state.where(F.col("ask").isNotNull())
    asked = open_rows.select("doc_id", "text_hash", F.explode(F.arrays_zip("ask", "hashes", "proofs")).alias("w")).select("doc_id", "text_hash", F.col("w.ask").alias("at"), F.col("w.hashes").alias("hash"), F.col("w.proofs").alias("proof"))
    firsts = asked.groupBy("hash", "proof").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first") < F.col("last")).drop("last")
    more = with_first(asked, materialize(firsts, "substring-windows"), ["hash", "proof"]).where(F.col("first") < F.col("doc_id")).groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("more"))
    end = T.StructType([T.StructField("doc_id", doc_type), *done, *(([*others, T.StructField("text", T.StringType())]) if carry is not None else [])])

    def close(batches):
        for b in text_batches(batches):
            out = []
            for t, gone, more in zip(binaries(b.column("text")), b.column("gone").to_pylist(), b.column("more").to_pylist(), strict=True):
                at = np.array(gone + (more or []), np.int64)
                out.append(finish(t, covered(len(t.split()), at, window)))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols[:3], *([*[b.column(f.name) for f in others], cols[3].cast(pa.string())] if carry is not None else [])], end.names)

    closed = open_rows.select("doc_id", "text_hash", "text", "gone", *[f.name for f in others]).join(more, ["doc_id", "text_hash"], "left").mapInArrow(close, end)
    return state.where(F.col("ask").isNull()).select(*final).unionByName(closed)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p : p + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM hit),
gones AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS q FROM d WHERE doc_id IN (SELECT doc_id FROM gones)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY q) AS x FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(x, '') END) AS kept_sha256
FROM d LEFT JOIN gones USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
