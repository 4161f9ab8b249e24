"""Best-fit packing: best-two-fit over the histogram of piece lengths.

Only how many pieces have each length matters for a packing, and there are at most `capacity` lengths. So Spark encodes
and counts; the plan is made from that bounded histogram as bin patterns with multiplicities: a bin is filled greedily
with the longest piece that fits, then its smallest piece gives way to the two unpacked pieces that fit the expanded gap
most tightly, if they fit it more tightly than it did. Pieces then find their bin by their rank among equal lengths; the
rank is the task's own count plus the counts of the tasks before it, so no length is ever gathered in one task.

Defined results: null text counts as empty and still has its end token; a document over `capacity` tokens is cut into
full pieces and a last one, however long it is; repeated rows are packed each; pieces of one length are interchangeable, so
which of them lies in which bin is left open; rows without id come back without one; an empty table gives an empty result.
Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import binaries, documents, hash_words, materialize, text_batches

LETTERS = re.compile("[a-zß-öø-ÿ]+")
CAPACITY, END_ID, CACHED_WORDS, CACHED_IDS = 4096, 1, 2_000_000, 8_000_000
TAILS = b".,:;!?)"
_TAIL = bytes(1 if c in TAILS else 0 for c in range(256))
_ALNUM = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(256)])

#: What the encoder builds on; of a tokenizer that normalises or splits in another way, every text is encoded whole.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordEncoder:
    """Token ids of texts by way of their distinct words, as the tokenizer drops white space and never looks across it.

    A word is known by the hash of its bytes after lower-casing A-Z; a mark of TAILS that ends it behind an ASCII letter,
    a digit or a Latin-1 letter is always split off by the tokenizer, so it counts by itself. Ids of known words lie in one flat array. When
    that holds over CACHED_IDS ids or CACHED_WORDS words, it is emptied, so its size follows neither vocabulary nor text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = splits_at_white_space(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        self.levels, self.ids, self.used, self.words = [], np.zeros(1 << 20, np.uint32), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where the ids of each key begin and how many there are; -1 where it isn't known."""
        out = np.full((2, len(keys)), -1, np.int64)
        for known, at, size in self.levels:
            i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[i] == keys
            out[0, hit], out[1, hit] = at[i[hit]], size[i[hit]]
        return out

    def remember(self, keys: np.ndarray, ids: list[np.ndarray], at: np.ndarray, sizes: np.ndarray) -> None:
        """Add ascending keys; levels are merged so that each is at least twice as long as the next."""
        flat = np.concatenate(ids)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.levels.append((keys, at, sizes))
        self.used, self.words = self.used + len(flat), self.words + len(keys)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels[-2:]
            both = np.concatenate([a[0], b[0]])
            by = np.argsort(both, kind="stable")
            self.levels[-2:] = [(both[by], *(np.concatenate([x, y])[by] for x, y in zip(a[1:], b[1:], strict=True)))]

    def learn(self, words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of words, how many each has, and the order in which the words' ids come."""
        texts = [w.decode() for w in words]
        kind = np.array([2 if w.isalpha() or LETTERS.fullmatch(t) else 1 if w.isascii() else 0 for w, t in zip(words, texts, strict=True)])
        ids, sizes = [], np.zeros(len(words), np.int64)
        plain = np.flatnonzero(kind == 2)
        if len(plain):
            e = self.plain.encode(" ".join([texts[i] for i in plain]), add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            sizes[plain] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(plain))
        plain_ascii = np.flatnonzero(kind == 1)
        if len(plain_ascii):
            e = self.tokenizer.encode(" ".join([texts[i] for i in plain_ascii]), add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            ends = np.cumsum([len(texts[i]) + 1 for i in plain_ascii])
            sizes[plain_ascii] = np.bincount(np.searchsorted(ends, np.array([x for x, _ in e.offsets], np.int64), "right"), minlength=len(plain_ascii))
        others = np.flatnonzero(kind == 0)
        for i, e in zip(others, self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            sizes[i] = len(e.ids)
        order = np.concatenate([plain, plain_ascii, others]).astype(np.int64)
        return ids, sizes, order

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each text's begin (one more entry than texts)."""
        if not self.by_words:
            rows = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([x for r in rows for x in r], np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        raw = b"\n" + b"\n".join(texts).lower() + b"\n"
        a = np.frombuffer(bytearray(raw), np.uint8)
        t = np.flatnonzero(np.frombuffer(raw.translate(_TAIL), bool))
        latin = (a[t - 2] == 0xC3) & (a[t - 1] >= 0x80) & (a[t - 1] != 0x97) & (a[t - 1] != 0xB7)
        t = t[(_ALNUM[a[t - 1]] | latin) & ((a[t + 1] == 32) | ((a[t + 1] >= 9) & (a[t + 1] <= 13)))]
        marks = a[t]
        a[t] = 32
        buf = a.tobytes()
        starts, ends, h = hash_words(buf, False)
        tail = np.zeros(len(h), np.uint8)
        tail[np.searchsorted(ends, t)] = marks
        keys, first, number = np.unique(h, return_index=True, return_inverse=True)
        if self.used > CACHED_IDS or self.words > CACHED_WORDS:
            self.forget()
        found = self.find(keys)
        new = np.flatnonzero(found[0] < 0)
        if len(new):
            ids, sizes, order = self.learn([buf[starts[i] : ends[i]] for i in first[new]])
            place = np.empty(len(new), np.int64)
            place[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
            self.remember(keys[new], ids, place, sizes)
            found[0, new], found[1, new] = place, sizes
        of_mark = np.zeros(256, np.uint32)
        for c in set(marks.tolist()):
            (of_mark[c],) = self.tokenizer.encode(chr(c), add_special_tokens=False).ids
        at, size = found[0][number], found[1][number]
        offsets = np.cumsum([1, *(len(x) + 1 for x in texts)])
        cuts = np.searchsorted(starts, offsets)
        total = size + (tail > 0)
        done = np.concatenate([[0], np.cumsum(total)])
        text = np.repeat(np.arange(len(texts)), np.diff(cuts))
        begin = done[:-1] + text
        bounds = done[cuts] + np.arange(len(texts) + 1)
        out = np.full(bounds[-1], end_id, np.uint32)
        spread = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + spread] = self.ids[np.repeat(at, size) + spread]
        marked = np.flatnonzero(tail)
        out[begin[marked] + size[marked]] = of_mark[tail[marked]]
        return out, bounds


def splits_at_white_space(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = (j.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (j.get("normalizer") or {}).get("normalizers") == NORMALIZERS and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and [x.get("type") for x in steps[1:]] == ["ByteLevel"] and steps[1].get("use_regex") is False


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place): place counts earlier pieces of that length in the task."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, k()) for n, k in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids_crc32", T.LongType), ("task", T.IntegerType), ("place", T.LongType))])

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in text_batches(batches, 4 << 20):
            ids, cuts = encoder(path).encode(binaries(b.column("text")), end_id)
            n = np.diff(cuts)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(capacity, n[doc] - piece * capacity)
            at = cuts[doc] + piece * capacity
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
            by = np.argsort(length, kind="stable")
            own = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(doc), np.int64)
            place[by] = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
            place += seen[length]
            seen += own
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(place)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, copies), ...], bins) that use the histogram up."""
    lens = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(x)] for x in lens], np.int64)
    out = []
    while len(lens):
        rem, gap, used = left.copy(), capacity, {}

        def take(i: int, n: int, rem=rem, used=used) -> None:
            rem[i] -= n
            used[i] = used.get(i, 0) + n

        i = len(lens) - 1
        while i >= 0 and gap >= lens[0]:
            i = min(i, int(np.searchsorted(lens, gap, "right")) - 1)
            while i >= 0 and rem[i] == 0:
                i -= 1
            if i < 0:
                break
            n = min(int(rem[i]), gap // int(lens[i]))
            take(i, n)
            gap -= n * int(lens[i])
        if gap:
            small = min(used)
            room = gap + int(lens[small])
            take(small, -1)
            free = np.flatnonzero(rem > 0)
            a = lens[free]
            j = np.searchsorted(a, np.minimum(room - a, a), "right") - 1
            j = np.where((j == np.arange(len(a))) & (rem[free] < 2), j - 1, j)
            sums = np.where((j >= 0) & (a < room), a + a[np.maximum(j, 0)], 0)
            k = int(np.argmax(sums))
            if sums[k] > lens[small] and sums[k] <= room:
                take(int(free[k]), 1)
                take(int(free[j[k]]), 1)
            else:
                take(small, 1)
        used = {i: n for i, n in used.items() if n}
        bins = min(int(left[i]) // n for i, n in used.items())
        out.append(([(int(lens[i]), n) for i, n in sorted(used.items(), reverse=True)], bins))
        for i, n in used.items():
            left[i] -= n * bins
        lens, left = lens[left > 0], left[left > 0]
    return out


def _places(patterns) -> np.ndarray:
    """Rows (length, first rank, copies a bin, first bin, offset), sorted by length and rank."""
    rows, rank, base = [], {}, 0
    for items, bins in patterns:
        offset = 0
        for n, copies in items:
            rows.append((n, rank.get(n, 0), copies, base, offset))
            rank[n] = rank.get(n, 0) + copies * bins
            offset += n * copies
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(pieces(docs, path, capacity, end_id), "packing-pieces")
    counts = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = _places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["length", "task"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    top = 1 << 42

    def place(batches):
        key = table[:, 0] * top + table[:, 1]
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            x = table[np.searchsorted(key, n * top + r, "right") - 1] if len(n) else table[:0]
            k = r - x[:, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(x[:, 3] + k // x[:, 2] if len(n) else [], pa.int64()), pa.array(x[:, 4] + k % x[:, 2] * n if len(n) else [], pa.int64())], schema.names)

    return ranked.select(*names, (F.col("before") + F.col("place")).alias("rank")).mapInArrow(place, schema)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
