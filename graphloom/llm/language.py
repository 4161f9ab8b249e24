"""Language of every word and text by a linear-chain conditional random field.

Features of a word: its byte n-grams within word borders (those at a border are the affixes) and the word itself as a
lexicon entry, all hashed. Emission weights and transitions are learned together by gradient steps on the exact
likelihood from forward-backward; training sequences join segments of documents of different languages, so transitions
are learned as in code-switched text. Prediction runs forward-backward over whole texts: pieces of a text get transfer
matrices, those are chained, then every word gets its posterior. A text's language has the largest mean posterior over
its words with letters. The fit uses at most `sample` labelled documents, an equal share for each language and `least` at
least, chosen by a hash of id and text.

Defined results: a null text or one without letters is `und` with score 0; without labelled rows every text is; of
languages on a tie the first by name is predicted; texts of any length are read whole; repeated rows are judged each; a
null doc_id counts as the text 'None' when rows are split; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import binaries, hash_words, text_batches

GRAMS, SLOTS, STEP, PIECE = (1, 2, 3, 4), 1 << 16, 64, 128
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words one after the other, and where each word's begin."""
    a = np.frombuffer(b" " + b" ".join(words).lower() + b" ", np.uint8).astype(np.uint32)
    n = np.array([len(w) for w in words])
    s = np.cumsum(n + 1) - n
    of, at = [np.arange(len(words))], []
    h = hash_words(b" ".join(words), True)[2]
    at.append((h >> np.uint64(48)).astype(np.int64) + SLOTS)
    for g in GRAMS:
        count = n + 3 - g
        word = np.repeat(np.arange(len(words)), count)
        p = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + s[word] - 1
        v = np.full(len(p), g, np.uint32)
        for k in range(g):
            v = (v ^ a[p + k]) * _MUL[k]
            v ^= v >> np.uint32(13)
        of.append(word)
        at.append((v >> np.uint32(16)).astype(np.int64))
    of, at = np.concatenate(of), np.concatenate(at)
    by = np.argsort(of, kind="stable")
    return at[by], np.searchsorted(of[by], np.arange(len(words) + 1))


def distinct(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, each word's number, and where each text's words begin."""
    buf = b" ".join(texts)
    s, e, h = hash_words(buf, True)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return [buf[s[i] : e[i]] for i in first], number, np.searchsorted(s, offsets)


def has_letter(words: list[bytes]) -> np.ndarray:
    """Whether a word has a character of Unicode category L."""
    return np.array([w.isalpha() or any(map(str.isalpha, w.decode())) for w in words], bool)


def emissions(words: list[bytes], weights: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Score of each language for each word; words without letters have none."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    at, cuts = features(words)
    return np.add.reduceat(weights[at], cuts[:-1], axis=0) * letters[:, None]


def forward_backward(e: np.ndarray, a: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (sequences, steps, languages) and expected transitions; e and a are exponentiated scores."""
    b, t, n = e.shape
    alpha, x = np.empty((b, t, n), e.dtype), start
    for i in range(t):
        x = (x @ a if i else x) * e[:, i]
        x = x / x.sum(1, keepdims=True)
        alpha[:, i] = x
    beta, moves, gamma = end, np.zeros((n, n)), np.empty_like(alpha)
    for i in range(t - 1, -1, -1):
        g = alpha[:, i] * beta
        gamma[:, i] = g / g.sum(1, keepdims=True)
        if i:
            y = e[:, i] * beta
            y = y / y.sum(1, keepdims=True)
            beta = y @ a.T
            moves += a * ((alpha[:, i - 1] / (alpha[:, i - 1] * beta).sum(1, keepdims=True)).T @ y)
    return gamma, moves


def fit(texts: list[bytes], labels: np.ndarray, n: int, rounds: int = 40, rate: float = 0.15, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (slots, languages) and transition scores."""
    words, number, cuts = distinct(texts)
    letters = has_letter(words)
    at, where = features(words)
    word_of = np.repeat(np.arange(len(words)), np.diff(where))
    label = np.repeat(labels, np.diff(cuts))
    rng = np.random.default_rng(5)
    breaks = np.unique(np.concatenate([cuts, np.cumsum(rng.integers(5, 60, len(number) // 5 + 1))]))
    breaks = breaks[breaks <= len(number)]
    parts = list(zip(breaks[:-1], breaks[1:], strict=True))
    order = np.concatenate([np.arange(*parts[i]) for i in rng.permutation(len(parts))]) if parts else np.zeros(0, int)
    order = np.resize(order, max(1, -(-len(order) // STEP)) * STEP)  # the last sequence is filled up from the first
    seq, gold = number[order].reshape(-1, STEP), label[order].reshape(-1, STEP)
    w, a = np.zeros((2 * SLOTS, n), np.float32), np.zeros((n, n))
    hot = np.eye(n)[gold]
    truth = np.zeros((n, n))
    np.add.at(truth, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    state = {k: [0.0, 0.0] for k in "wa"}
    share = np.full((len(seq), n), 1 / n)
    for r in range(1, rounds + 1):
        e = np.exp(np.clip(emissions(words, w, letters), -30, 30))[seq]
        gamma, moves = forward_backward(e, np.exp(a), share, np.ones_like(share))
        d = (hot - gamma).reshape(-1, n)
        per_word = np.stack([np.bincount(seq.ravel(), d[:, k], len(words)) for k in range(n)], 1) * letters[:, None]
        gw = np.stack([np.bincount(at, per_word[word_of, k], len(w)) for k in range(n)], 1) / seq.size - ridge * w
        ga = (truth - moves) / seq.size - ridge * a
        for key, g in (("w", gw), ("a", ga)):
            m, v = state[key]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[key] = [m, v]
            move = rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
            if key == "w":
                w += move.astype(np.float32)
            else:
                a += move
    return w, a


def posteriors(e: np.ndarray, cuts: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Posterior of every word; texts lie between the cuts. Texts are cut into pieces that are chained exactly."""
    n = e.shape[1]
    size = np.diff(cuts)
    pieces = -(-size // PIECE)
    first = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    if not total:
        return np.zeros_like(e)
    text = np.repeat(np.arange(len(size)), pieces)
    begin = cuts[text] + (np.arange(total) - first[text]) * PIECE
    length = np.minimum(PIECE, cuts[text + 1] - begin)
    slot = begin[:, None] + np.arange(PIECE)
    inside = np.arange(PIECE) < length[:, None]
    x = np.where(inside[:, :, None], np.exp(np.clip(e - e.max(1, keepdims=True), -60, 0))[np.where(inside, slot, 0)], 1.0)
    move = np.exp(a)
    move /= move.sum()
    eye = np.eye(n)
    whole = np.broadcast_to(eye, (total, n, n)).copy()
    for i in range(PIECE):
        step = (whole @ move) * x[:, i, None, :]
        step /= step.max((1, 2), keepdims=True)
        whole = np.where(inside[:, i, None, None], step, whole)
    ahead, behind = np.full((total, n), 1 / n), np.ones((total, n))
    for k in range(1, int(pieces.max())):
        p = first[pieces > k] + k
        y = (ahead[p - 1, None, :] @ whole[p - 1])[:, 0]
        ahead[p] = y / y.sum(1, keepdims=True)
        q = first[pieces > k] + pieces[pieces > k] - 1 - k
        z = (whole[q + 1] @ behind[q + 1, :, None])[:, :, 0]
        behind[q] = z / z.sum(1, keepdims=True)
    alpha, y = np.empty((total, PIECE, n)), ahead
    for i in range(PIECE):
        step = (y @ move) * x[:, i]
        y = np.where(inside[:, i, None], step / step.sum(1, keepdims=True), y)
        alpha[:, i] = y
    out, beta = np.empty_like(e), behind
    for i in range(PIECE - 1, -1, -1):
        g = alpha[:, i] * beta
        ok = inside[:, i]
        out[slot[ok, i]] = (g / g.sum(1, keepdims=True))[ok]
        z = (x[:, i] * beta) @ move.T
        beta = np.where(ok[:, None], z / z.sum(1, keepdims=True), beta)
    return out


def held(doc_id, folds: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("None"))), F.lit(folds)) == 0


def chosen(rows: DataFrame, sample: int, least: int) -> DataFrame:
    """Of each language's rows its share of `sample`, `least` at least, or all if fewer: those first by a hash of id and text.

    A threshold on the hash, from the language's count, comes before the ranking, so no ranking sees a whole language.
    """
    counts = rows.groupBy("lang").count()
    quota = max(least, sample // max(1, counts.count()))
    share = F.least(F.lit(1.0), (quota + 6 * quota**0.5 + 10) / F.col("count"))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    some = rows.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(h <= F.col("share") * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", "text"))
    return some.withColumn("rank", rank).where(F.col("rank") <= quota).select("lang", "text")


def train(docs: DataFrame, folds: int, sample: int, least: int = 50) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, emission weights and transitions, from labelled documents outside the held-out fold.

    Every language that occurs there is learned, however rare: each has an equal share of `sample` documents, but
    `least` at least, so the fit sees at most max(sample, least * languages) of them.
    """
    rows = docs.where(~held(F.col("doc_id"), folds) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    rows = sorted(chosen(rows, sample, least).collect())
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return [], np.zeros((0, 0)), np.zeros((0, 0))
    texts = [r["text"].encode() for r in rows]
    return langs, *fit(texts, np.array([langs.index(r["lang"]) for r in rows]), len(langs))


def identify(docs: DataFrame, folds: int = 5, sample: int = 800) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and the share of words in each learned language."""
    langs, w, a = train(docs, folds, sample)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("word_shares", T.ArrayType(T.DoubleType()))])
    weights = docs.sparkSession.sparkContext.broadcast((w, a))

    def run(batches):
        w, a = weights.value
        for b in text_batches(batches):
            texts = binaries(b.column("text"))
            rows = [("und", 0.0, None)] * len(texts)
            if langs:
                words, number, cuts = distinct(texts)
                letters = has_letter(words)
                p = posteriors(emissions(words, w, letters)[number], cuts, a) * letters[number][:, None]
                sums = np.zeros((len(number) + 1, len(langs)))
                np.cumsum(p, axis=0, out=sums[1:])
                some = np.concatenate([[0], np.cumsum(letters[number])])
                n = some[cuts[1:]] - some[cuts[:-1]]
                mean = np.clip((sums[cuts[1:]] - sums[cuts[:-1]]) / np.maximum(n, 1)[:, None], 0, 1)
                rows = [(langs[int(m.argmax())], float(m.max()), m.tolist()) if k else r for r, m, k in zip(rows, mean, n, strict=True)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.float64()))], schema.names)

    return docs.select("doc_id", held(F.col("doc_id"), folds).alias("held_out"), "text").mapInArrow(run, schema)


def label_words(texts: list[str], langs: list[str], w: np.ndarray, a: np.ndarray) -> list[list[str]]:
    """The likeliest language of every word of each text."""
    words, number, cuts = distinct([t.encode() for t in texts])
    p = posteriors(emissions(words, w, has_letter(words))[number], cuts, a)
    best = [langs[i] for i in p.argmax(1)]
    return [best[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
