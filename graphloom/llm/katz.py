"""Language-model scoring by Katz backoff over word bigrams.

Texts become blocks of word numbers with a vocabulary of their own. A block asks for the training count of each of its
distinct words and bigrams once; asks and answers are sorted key arrays, partitioned by key, so a frequent bigram costs
one entry per block and never gathers its occurrences. Scores then recurse per token: a bigram seen in training has its
discounted share, any other the history's backoff weight times the word's own share, and an unknown word what the
words' discounts left over. Backoff weights are exact: every distinct bigram is owned by one block, which adds it to the
integer sums from which its history's weight is computed.

Discounts: Good-Turing for counts up to 5 (where the counts of counts give no ratio within (0, 1): half a count off);
higher counts lose half a count as well, so that every history keeps something to back off with.

Defined results: A-Z count as a-z; a null text has only its end token; texts of any length are scored whole; a null id
counts as the text 'None' when documents are split, and ids are read as whole numbers; repeated rows are scored each, and equal counts have equal shares;
without training documents every token is unknown; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binaries, buckets, crc_mod, documents, materialize, mix, pack, pack_sorted, text_batches, unpack, unpack_sorted, words_of

K = 5
END, START = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
MESSAGE = "kind int, block long, bucket int, a binary, b binary, doc_ids array<long>"
BLOCK, WORDS, PAIRS, DOCS, SUMS, ASK, WEIGHTS = range(7)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["kind", "block", "bucket", "a", "b", "doc_ids"])


def bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n key ranges begins in ascending keys."""
    return np.searchsorted((((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64), np.arange(n + 1))


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(w + START))


def text_blocks(docs: DataFrame, folds: int, size: int) -> DataFrame:
    """A row for about `size` bytes of text: a = vocabulary by falling frequency, b = (held out, tokens a text, word numbers)."""

    def run(batches):
        task, i = TaskContext.get().partitionId(), 0
        for b in text_batches(batches, size):
            ids = b.column("doc_id").to_pylist()
            h, cuts = words_of(binaries(b.column("text")), True)
            n = np.diff(cuts) + 1
            words = np.full(len(h) + len(ids), END, np.uint64)
            words[np.arange(len(h)) + np.repeat(np.arange(len(ids)), n - 1)] = h
            vocabulary, number, count = np.unique(words, return_inverse=True, return_counts=True)
            by = np.argsort(-count, kind="stable")
            place = np.empty(len(by), np.uint32)
            place[by] = np.arange(len(by), dtype=np.uint32)
            held = np.array([crc_mod(x, folds) == 0 for x in ids])
            yield _messages([(BLOCK, (task << 24) + i, 0, pack(vocabulary[by]), pack(held, n.astype(np.uint32), place[number]), ids)])
            i += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MESSAGE)


class Block:
    """One block's tokens, distinct words and distinct bigrams, both by ascending key."""

    def __init__(self, a: bytes, b: bytes):
        self.vocabulary = unpack(a)[0]
        self.held, self.n, self.word = unpack(b)
        v = len(self.vocabulary)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        word = self.word.astype(np.int64)
        before = np.concatenate([[v], word[:-1]])
        before[np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64)] = v
        code, self.pair = np.unique(before * (v + 1) + word, return_inverse=True)
        self.h, self.w = code // (v + 1), code % (v + 1)
        self.hash = np.append(self.vocabulary, START)
        keys = pair_key(self.hash[self.h], self.hash[self.w])
        self.pair_order, self.word_order = np.argsort(keys), np.argsort(self.vocabulary)
        self.pair_keys, self.word_keys = keys[self.pair_order], self.vocabulary[self.word_order]
        self.train = ~self.held[self.doc].astype(bool)

    def asks(self, block: int, n: int) -> list[tuple]:
        out = []
        for kind, of, order, keys in ((WORDS, self.word.astype(np.int64), self.word_order, self.word_keys), (PAIRS, self.pair, self.pair_order, self.pair_keys)):
            count = np.bincount(of[self.train], minlength=len(keys))[order].astype(np.uint32)
            at = bounds(keys, n)
            out += [(kind, block, i, pack_sorted(keys[x:y]), pack(count[x:y]), None) for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
        return out


def _answers(table: pa.Table) -> pa.Table:
    """Total count of each asked key, and whether the block owns the key; a row of counts of counts with block -1."""
    rows, out = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"])), []
    for kind in (WORDS, PAIRS):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        keys = [unpack_sorted(r["a"]) for r in own]
        counts = np.concatenate([unpack(r["b"])[0] for r in own]).astype(np.int64)
        sizes = [len(k) for k in keys]
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, counts).astype(np.int64)
        lead = np.zeros(len(number), bool)
        trained = np.flatnonzero(counts > 0)
        lead[trained[np.unique(number[trained], return_index=True)[1]]] = True
        at = np.concatenate([[0], np.cumsum(sizes)])
        out += [(kind, r["block"], r["bucket"], pack(total[number[x:y]].astype(np.uint32)), pack(np.packbits(lead[x:y])), None) for r, x, y in zip(own, at[:-1], at[1:], strict=True)]
        out.append((kind, -1, own[0]["bucket"], pack(np.array([(total == r).sum() for r in range(1, K + 2)] + [(total > 0).sum(), total.sum()], np.int64)), None, None))
    return pa.Table.from_batches([_messages(out)])


def good_turing(n: np.ndarray) -> np.ndarray:
    """What remains of each count 1..K, from the counts of counts 1..K+1."""
    r = np.arange(1, K + 1)
    with np.errstate(all="ignore"):
        common = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
    return r * np.where((d > 0) & (d < 1), d, (r - 0.5) / r)


class Shares:
    """Discounted counts of words and bigrams, and the words' shares."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.left = [np.concatenate([[0.0], good_turing(x[: K + 1].astype(float))]) for x in (words, pairs)]
        self.kinds, self.tokens = int(words[K + 1]), int(words[K + 2])
        few = words[:K].astype(float)
        big, n_big = self.tokens - (few * np.arange(1, K + 1)).sum(), self.kinds - few.sum()
        self.known = ((few * self.left[0][1:]).sum() + big - 0.5 * n_big) / max(1, self.tokens)

    def discounted(self, order: int, c: np.ndarray) -> np.ndarray:
        return np.where(c <= K, self.left[order][np.minimum(c, K)], c - 0.5)

    def word(self, c: np.ndarray) -> np.ndarray:
        """Share of words with training count c; 0 stands for any unknown word."""
        return np.where(c > 0, self.discounted(0, c) / max(1, self.tokens), 1 - self.known)


def _of_block(rows: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"])
    counts = [unpack(r["a"])[0] for r in own]
    return np.concatenate(counts).astype(np.int64), np.concatenate([np.unpackbits(unpack(r["b"])[0], count=len(c)) for r, c in zip(own, counts, strict=True)]).astype(bool)


def _sum_by(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, values, n)


def score_block(table: pa.Table, shares: Shares, n: int) -> pa.Table:
    """Per text what is known without backoff weights; what the block asks for; its part of the histories' sums."""
    rows = table.to_pylist()
    mine = next(r for r in rows if r["kind"] == BLOCK)
    b = Block(mine["a"], mine["b"])
    words, pairs, owned = np.empty(len(b.word_keys), np.int64), np.empty(len(b.pair_keys), np.int64), np.empty(len(b.pair_keys), bool)
    words[b.word_order] = _of_block(rows, WORDS)[0]
    pairs[b.pair_order], owned[b.pair_order] = _of_block(rows, PAIRS)
    history = np.append(words, words[b.vocabulary == END])  # as many texts begin as end
    docs = len(b.n)
    c = words[b.word]
    base = _sum_by(np.log10((c + 0.1) / (shares.tokens + 0.1 * (shares.kinds + 1))), b.doc, docs)
    known = _sum_by((c > 0).astype(float), b.doc, docs).astype(np.int64)
    seen = pairs > 0
    part = np.log10(np.where(seen, shares.discounted(1, pairs) / np.maximum(1, history[b.h]), shares.word(words[b.w])))
    score = _sum_by(part[b.pair], b.doc, docs)
    backs = ~seen & (history[b.h] > 0)
    token = np.flatnonzero(backs[b.pair])
    asked, number = np.unique(b.hash[b.h[b.pair[token]]], return_inverse=True)
    out = [(DOCS, mine["block"], 0, pack(b.held, b.n, known, base, score), pack(b.doc[token].astype(np.uint32), number.astype(np.uint32)), mine["doc_ids"])]
    at = bounds(asked, n)
    out += [(ASK, mine["block"], i, pack_sorted(asked[x:y]), None, None) for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
    own = np.flatnonzero(owned)
    if len(own):
        h, group = np.unique(b.hash[b.h[own]], return_inverse=True)
        c, cw = pairs[own], words[b.w[own]]
        sums = [_sum_by((x == r).astype(float), group, len(h)) for x in (c, cw) for r in range(1, K + 1)]
        sums += [_sum_by(y, group, len(h)) for x in (c, cw) for y in ((x > K).astype(float), np.where(x > K, x, 0))]
        sums = [s.astype(np.int64) for s in sums]
        at = bounds(h, n)
        out += [(SUMS, mine["block"], i, pack_sorted(h[x:y]), pack(*[s[x:y].astype(np.uint32) if s.max() < 2**32 else s[x:y] for s in sums]), None) for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
    return pa.Table.from_batches([_messages(out)])


def weights(table: pa.Table, shares: Shares) -> pa.Table:
    """log10 of the backoff weight of every asked history."""
    rows = table.to_pylist()
    parts, asks = [r for r in rows if r["kind"] == SUMS], [r for r in rows if r["kind"] == ASK]
    if not asks:
        return pa.Table.from_batches([_messages([])])
    h, group = np.unique(np.concatenate([unpack_sorted(r["a"]) for r in parts]), return_inverse=True)
    cols = [_sum_by(np.concatenate(c).astype(float), group, len(h)) for c in zip(*[unpack(r["b"]) for r in parts], strict=True)]
    r = np.arange(1, K + 1)[:, None]
    pair, word = np.array(cols[:K]), np.array(cols[K : 2 * K])
    n_big, big, w_big, w_sum = cols[2 * K :]
    total = (pair * r).sum(0) + big
    left = total - ((pair * shares.left[1][1:, None]).sum(0) + big - 0.5 * n_big)
    other = 1 - ((word * shares.left[0][1:, None]).sum(0) + w_sum - 0.5 * w_big) / shares.tokens
    alpha = np.log10(left / total / other)
    return pa.Table.from_batches([_messages([(WEIGHTS, x["block"], x["bucket"], pack(alpha[np.searchsorted(h, unpack_sorted(x["a"]))]), None, None) for x in asks])])


def katz_scores(docs: DataFrame, folds: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = materialize(text_blocks(docs, folds, block_bytes), "katz-blocks")
    n = max(buckets(docs.sparkSession), -(-blocks.count() // 4))  # so many parts that none grows with the data

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield _messages(Block(r["a"], r["b"]).asks(r["block"], n))

    answers = materialize(blocks.mapInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(_answers, MESSAGE), "katz-counts")
    totals = {kind: np.zeros(K + 3, np.int64) for kind in (WORDS, PAIRS)}
    for r in answers.where("block = -1").select("kind", "a").collect():  # a few numbers for each bucket
        totals[r["kind"]] += unpack(bytes(r["a"]))[0]
    shares = Shares(totals[WORDS], totals[PAIRS])
    scored = materialize(blocks.unionByName(answers.where("block >= 0")).groupBy("block").applyInArrow(lambda t: score_block(t, shares, n), MESSAGE), "katz-scored")
    found = scored.where(F.col("kind").isin(SUMS, ASK)).groupBy("bucket").applyInArrow(lambda t: weights(t, shares), MESSAGE)
    schema = T.StructType([T.StructField(x, k()) for x, k in (("doc_id", T.LongType), ("held_out", T.BooleanType), ("n_tokens", T.LongType), ("n_known", T.LongType), ("train_tokens", T.LongType), ("base_score", T.DoubleType), ("score", T.DoubleType))])

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        mine = next(r for r in rows if r["kind"] == DOCS)
        held, tokens, known, base, score = unpack(mine["a"])
        doc, number = unpack(mine["b"])
        alpha = [unpack(r["a"])[0] for r in sorted((r for r in rows if r["kind"] == WEIGHTS), key=lambda r: r["bucket"])]
        if alpha:
            score = score + _sum_by(np.concatenate(alpha)[number], doc, len(score))
        return pa.table([pa.array(mine["doc_ids"], pa.int64()), pa.array(held.astype(bool)), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(np.full(len(known), shares.tokens)), pa.array(base), pa.array(score)], schema.names)

    return scored.where(F.col("kind") == DOCS).unionByName(found).groupBy("block").applyInArrow(finish, schema)


def op8_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))
