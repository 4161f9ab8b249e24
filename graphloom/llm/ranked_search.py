"""Ranked lexical search by Block-Max MaxScore over shards of compressed postings.

Index. Each task cuts its documents into shards of bounded size and writes, for every term of a shard, its postings in
blocks of 128 (differences of document numbers and frequencies, in as many bytes as the block needs) and, apart from them,
a header of each block: first and last document, and for frequencies 1, 2, 3 and more the length of the shortest document
that has it, from which the block's greatest possible score follows once the corpus's counts are known.

Search, for a block of items and a shard at a time. An item's lists are ordered by their global bound (weight times the
best block). They are read whole, best first, for as long as the rest together could lift a new document over the
threshold: these are the essential lists. Of the rest, a candidate is given up once its score, the block maximum at its
place and the bounds of the lists behind can't reach the threshold; only blocks that still hold a candidate are unpacked.
The threshold is the k-th best partial score so far, and begins at the k-th best of a first sixteenth of the shards. Each
shard returns its k best; the k best of those win.

Nothing moves but postings of the items' terms. Items are searched in blocks of bounded number, each a job of its own over
the same index; only a block's terms and thresholds pass through the driver.

Defined results: a null text or item has no term; documents without any aren't counted and never found; every row is a
document, also where rows repeat an id, and rows without id count and come last among equals; items that share an id are
one item with the terms of all; equal scores go by ascending doc_id; a text of any length is read whole; an empty table
gives an empty result. Only the id and the text of either table are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binaries, discard, documents, hash_words, materialize, pack, text_batches, unpack

BLOCK, SHARD_BYTES, ITEMS, ONE = 128, 8 << 20, 256, 10**9
NONE = 0xFFFFFFFF
INDEX = "shard long, term binary, df long, heads binary, body binary"
HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("at", "<u4"), ("most", "<u4"), ("short", "<u4", 4), ("size", "u1"), ("gap_bytes", "u1"), ("tf_bytes", "u1"), ("pad", "u1")])

#: Digits, letters in lower case and all bytes beyond ASCII stay; anything else parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _same_words(buf: bytes, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> bool:
    """Whether the words at a (of n bytes) and at b (of m bytes) are the same, pair by pair."""
    if (n != m).any():
        return False
    eight = np.ndarray((len(buf) + 1,), "<u8", buf + bytes(8), strides=(1,))
    masks = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
    off = 0
    while len(a):
        if ((eight[a + off] ^ eight[b + off]) & masks[np.minimum(n - off, 8)]).any():
            return False
        off += 8
        more = n > off
        a, b, n = a[more], b[more], n[more]
    return True


def postings(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, where the postings of each begin (one more entry), documents, frequencies; and the length of each document."""
    buf = b" ".join(texts).translate(TERM_BYTES)
    starts, ends, h = hash_words(buf, False)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    lengths = np.diff(np.searchsorted(starts, offsets))
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
    if not len(h):
        return [], np.zeros(1, np.int64), doc, doc, lengths
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    n = ends - starts
    a, b = order[:-1][same], order[1:][same]
    if not _same_words(buf, starts[a], starts[b], n[a], n[b]):  # two words with one hash: tell them by their bytes
        number: dict[bytes, int] = {}
        h = np.array([number.setdefault(buf[s:e], len(number)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
        order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    term = np.concatenate([[True], h[1:] != h[:-1]])
    begin = np.flatnonzero(term | np.concatenate([[True], doc[1:] != doc[:-1]]))
    tf = np.diff(begin, append=len(h)).astype(np.uint32)
    at = np.flatnonzero(term[begin])
    example = order[begin[at]]
    terms = [buf[s:e] for s, e in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
    return terms, np.append(at, len(begin)), doc[begin], tf, lengths


def blocks(at: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Headers, the first header of each term, packed bytes, and the first byte of each term (one more entry each)."""
    df = np.diff(at)
    per = -(-df // BLOCK)
    first_head = np.concatenate([[0], np.cumsum(per)])
    start = np.repeat(at[:-1], per) + BLOCK * (np.arange(first_head[-1]) - np.repeat(first_head[:-1], per))
    size = np.minimum(BLOCK, np.repeat(at[1:], per) - start)
    of = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(doc)) - start[of]
    gap = np.where(place > 0, doc - np.concatenate([doc[:1], doc[:-1]]), 0).astype(np.uint32)
    heads = np.zeros(len(start), HEAD)
    width = lambda x: np.select([x < 1, x < 1 << 8, x < 1 << 16], [0, 1, 2], 4)
    heads["first"], heads["last"], heads["size"] = doc[start], doc[start + size - 1], size - 1
    heads["most"] = np.maximum.reduceat(tf, start)
    heads["gap_bytes"] = width(np.maximum.reduceat(gap, start))
    heads["tf_bytes"] = np.where(heads["most"] > 1, width(heads["most"]), 0)
    n = lengths[doc].astype(np.uint32)
    for c in range(4):
        heads["short"][:, c] = np.minimum.reduceat(np.where((tf == c + 1) if c < 3 else (tf > 3), n, np.uint32(NONE)), start)
    total = size * (heads["gap_bytes"].astype(np.int64) + heads["tf_bytes"])
    base = np.cumsum(total) - total
    first_byte = np.append(base, total.sum())[first_head]
    heads["at"] = base - np.repeat(first_byte[:-1], per)
    body = np.zeros(int(total.sum()), np.uint8)
    for values, wide, after in ((gap, heads["gap_bytes"], 0), (tf, heads["tf_bytes"], size * heads["gap_bytes"].astype(np.int64))):
        lead = base + after
        for k in range(4):
            here = np.flatnonzero(wide[of] > k)
            body[lead[of[here]] + k * size[of[here]] + place[here]] = (values[here] >> np.uint32(8 * k)) & np.uint32(255)
    return heads, first_head, body, first_byte


def _cut(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def shard_rows(shard: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    """A row for each term, and one with an empty term for the documents: ids, lengths, and which have an id."""
    terms, at, doc, tf, lengths = postings(texts)
    docs = pack(np.array([i or 0 for i in ids], np.int64), lengths.astype(np.int64), np.array([i is not None for i in ids], np.uint8))
    if terms:
        heads, first_head, body, first_byte = blocks(at, doc, tf, lengths)
        columns = [_cut(heads, first_head * HEAD.itemsize), _cut(body, first_byte)]
    else:
        columns = [pa.array([], pa.binary())] * 2
    columns = [pa.concat_arrays([c, pa.array([x], pa.binary())]) for c, x in zip(columns, (docs, b""), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms) + 1, shard)), pa.array([*terms, b""], pa.binary()), pa.array(np.append(np.diff(at), 0)), *columns], ["shard", "term", "df", "heads", "body"])


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index rows of all documents, in place: no row moves."""

    def run(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in text_batches(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), binaries(b.column("text")), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t) + 16
                if held >= shard_bytes:
                    yield from _parts(shard_rows(number, ids, texts))
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield from _parts(shard_rows(number, ids, texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def _parts(batch: pa.RecordBatch, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def corpus_counts(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches):
        n = total = 0
        for b in batches:
            for blob in b.column("heads").to_pylist():
                lengths = unpack(blob)[1]
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    r = index.where(F.col("term") == F.lit(b"")).select("heads").mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return r["n"] or 0, r["total"] or 0


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (ONE * tf) // (1000 * tf + 20 * m)


def slowed(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """A document's m: 100 - 50 + (50 * length * n) div total."""
    if 50 * n * int(lengths.max(initial=0)) < 1 << 63:
        return 50 + (50 * n * lengths.astype(np.int64)) // total
    return np.array([50 + 50 * n * x // total for x in lengths.tolist()], np.int64)


class List:
    """A term's postings in a shard: headers at once, blocks when asked for."""

    def __init__(self, heads: bytes, body: bytes, m: np.ndarray, n: int, total: int):
        self.heads, self.body, self.m = np.frombuffer(heads, HEAD), body, m
        short, most = self.heads["short"], self.heads["most"].astype(np.int64)
        tf = np.stack([np.full(len(most), 1), np.full(len(most), 2), np.full(len(most), 3), np.maximum(most, 1)], 1)
        self.best = np.where(short == NONE, 0, impact(tf, slowed(np.where(short == NONE, 0, short).ravel(), n, total).reshape(short.shape))).max(1)
        self.bound = int(self.best.max())
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and impacts of a block."""
        if i not in self.read:
            h = self.heads[i]
            size, at, gaps, tfs = int(h["size"]) + 1, int(h["at"]), int(h["gap_bytes"]), int(h["tf_bytes"])
            raw = np.frombuffer(self.body, np.uint8, size * (gaps + tfs), at).reshape(gaps + tfs, size).astype(np.int64)
            doc, tf = np.zeros(size, np.int64), np.zeros(size, np.int64) if tfs else np.ones(size, np.int64)
            for k in range(gaps):
                doc += raw[k] << (8 * k)
            for k in range(tfs):
                tf += raw[gaps + k] << (8 * k)
            doc = int(h["first"]) + np.cumsum(doc)
            self.read[i] = doc, impact(tf, self.m[doc])
        return self.read[i]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(i) for i in range(len(self.heads))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Shard:
    """Searches one shard; counts the blocks that its items' lists have, and those unpacked."""

    def __init__(self, docs: tuple[bytes, bytes], lists: dict[bytes, tuple[bytes, bytes]], n: int, total: int):
        self.ids, lengths, named = unpack(docs[0])
        self.unnamed = named == 0
        m = slowed(lengths, n, total)
        self.lists = {t: List(*x, m, n, total) for t, x in lists.items()}

    def best(self, terms: list[tuple[bytes, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents that reach the floor."""
        used = sorted(((w * self.lists[t].bound, w, self.lists[t]) for t, w in terms if w > 0 and t in self.lists), key=lambda x: -x[0])
        rest = np.append(np.cumsum([x[0] for x in used][::-1])[::-1], 0) if used else np.zeros(1, np.int64)
        score, threshold, i = np.zeros(len(self.ids), np.int64), max(1, floor), 0
        while i < len(used) and rest[i] >= threshold:  # an essential list: it could still bring a new document
            _, w, x = used[i]
            doc, gain = x.whole()
            score[doc] += w * gain
            threshold = max(threshold, _kth(score, k))
            i += 1
        held = np.flatnonzero(score + rest[i] >= threshold)
        for j in range(i, len(used)):
            _, w, x = used[j]
            of = np.searchsorted(x.heads["last"], held)
            there = of < len(x.heads)
            there[there] = x.heads["first"][of[there]] <= held[there]
            gain = np.where(there, w * x.best[np.minimum(of, len(x.heads) - 1)], 0)
            fine = score[held] + gain + rest[j + 1] >= threshold
            held, of, there = held[fine], of[fine], there[fine]
            for b in np.unique(of[there]).tolist():
                doc, gain = x.block(b)
                mine = held[of == b]
                at = np.minimum(np.searchsorted(doc, mine), len(doc) - 1)
                hit = doc[at] == mine
                score[mine[hit]] += w * gain[at[hit]]
            threshold = max(threshold, _kth(score[held], k))
            held = held[score[held] + rest[j + 1] >= threshold]
        held = held[score[held] >= threshold]
        order = np.lexsort((self.ids[held], self.unnamed[held], -score[held]))[:k]
        return held[order], score[held[order]]


def _kth(score: np.ndarray, k: int) -> int:
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def _items(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item."""

    def run(batches):
        for b in batches:
            terms = [sorted(set(t.translate(TERM_BYTES).split())) for t in binaries(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<binary>")
    return own.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)


def _search(index: DataFrame, wanted: dict, floors: dict, k: int, n: int, total: int) -> DataFrame:
    """The k best documents of every shard for each item. wanted: (term, weight) pairs by item."""

    def run(rows: pa.Table) -> pa.Table:
        docs, lists = None, {}
        for t, heads, body in zip(*(rows.column(c).to_pylist() for c in ("term", "heads", "body")), strict=True):
            if t:
                lists[t] = heads, body
            else:
                docs = heads, body
        shard = Shard(docs, lists, n, total)
        found = [[], [], []]
        for item, terms in wanted.items():
            doc, score = shard.best(terms, k, floors.get(item, 0))
            found[0] += [item] * len(doc)
            found[1] += [None if none else i for i, none in zip(shard.ids[doc].tolist(), shard.unnamed[doc].tolist(), strict=True)]
            found[2] += score.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in found], ["item_id", "doc_id", "score"])

    return index.groupBy("shard").applyInArrow(run, "item_id long, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, items_a_block: int = ITEMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    spark = docs.sparkSession
    index = materialize(build_index(docs, shard_bytes), "search-index")
    n, total = corpus_counts(index)
    asked = materialize(_items(items), "search-items")
    turns = max(1, -(-asked.count() // items_a_block))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in range(turns if n else 0):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn)
        terms = materialize(block.select(F.explode("terms").alias("term")).distinct(), "search-terms")
        lists = index.join(F.broadcast(terms), "term", "left_semi")  # the terms of one block of items
        df = {bytes(r["term"]): r["df"] for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        wanted = {r["item_id"]: [(bytes(t), weight(n, df[bytes(t)])) for t in r["terms"] if bytes(t) in df] for r in block.collect()}
        needed = lists.unionByName(index.where(F.col("term") == F.lit(b"")))
        early = F.pmod(F.xxhash64("shard"), F.lit(16)) == 0
        first = materialize(_top(_search(needed.where(early), wanted, {}, k, n, total), k), "search-first")
        floors = {r["item_id"]: r["score"] for r in first.where(F.col("rank") == k).collect()}  # one number an item
        both = first.select("item_id", "doc_id", "score").unionByName(_search(needed.where(~early), wanted, floors, k, n, total))
        found = found.unionByName(materialize(_top(both, k).select("item_id", "rank", "doc_id", "score"), "search-found"))
        discard(terms, first)
    discard(index, asked)
    return found


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
size AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
tfs AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term), size GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
