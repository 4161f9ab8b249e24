"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes one flat symbol array per batch, cut into words (a run of word marks and what follows it; a line feed also
begins a word, as no piece holds one). Each round looks up the rank of every neighbouring pair, takes the least rank of
each word by a segmented minimum, merges all its leftmost non-overlapping occurrences at once and compacts the array;
words without a pair left drop out. A piece that may be overtaken by a longer one made from it merges one occurrence a
round, which is the library's order. Words are also cut where no piece holds the two characters that meet, so that text
without spaces falls into short parts. Words met before in the worker are remembered, up to a fixed number of bytes; long
ones are not.

For models with identity normalisation, dummy prefix and byte fallback. Defined results: null counts as empty, an empty
text has no ids; a text of any length is encoded whole; of pairs of one rank the leftmost merges first, as in the library;
repeated rows, and rows without id, are encoded each; an empty table gives an empty result. Only doc_id and text are read,
so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import binaries, documents, text_batches

MARK, CACHED_BYTES, LONG_WORD = "▁", 24 << 20, 64
NONE = np.iinfo(np.int32).max


class PieceCodec:
    """The model's merge table as arrays, and the words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = set(self.bytes) | {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        ids = {p: i for i, p in enumerate(names) if i not in special}
        scores = {i: model.get_score(i) for i in ids.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.base = n + len(symbols) + 1
        pairs, overtaken = {}, set()
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]] * self.base + symbols[p[k:]]] = i
                    overtaken |= {x for x in (symbols[p[:k]], symbols[p[k:]]) if scores.get(x, 1) <= scores[i]}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[int(k)] for k in self.keys], np.int64)
        self.rank = np.array([order[scores[int(i)]] for i in self.made], np.int32)
        self.slow_ranks = np.array(sorted({order[scores[i]] for i in overtaken}), np.int32)
        self.char = np.full(0x110000, -1, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.n = n
        self.surface = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])
        self.lines = not any("\n" in p for p in ids)
        self.words = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.lines else f"{MARK}+[^{MARK}]*")
        joint = {(ord(a), ord(b)) for p in ids for a, b in zip(p, p[1:], strict=False)}
        self.joint = np.array(sorted(a << 32 | b for a, b in joint), np.int64)
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, bytes] = {}
        self.held = 0

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by rounds of simultaneous merges."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words])
        sym, owner = self.char[code], np.repeat(np.arange(len(words)), size)
        sym = np.where(sym < 0, -1 - code.astype(np.int64), sym)
        pair = code[:-1].astype(np.int64) << 32 | code[1:]
        apart = self.joint[np.minimum(np.searchsorted(self.joint, pair), len(self.joint) - 1)] != pair
        word = np.concatenate([[0], np.cumsum(apart | (owner[:-1] != owner[1:]))]) if len(code) else owner
        of_part = owner[np.flatnonzero(np.diff(word, prepend=-1))]
        done_sym, done_word = [], []
        while len(sym):
            key = np.where((word[:-1] == word[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0), sym[:-1] * self.base + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.rank[at], NONE), NONE)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(starts, append=len(sym))
            spread = np.repeat(least, counts)
            over = spread == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = np.flatnonzero((rank == spread) & ~over)
            if len(hit):
                fresh = np.diff(hit, prepend=-2) != 1
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                keep = (np.arange(len(hit)) - run) % 2 == 0
                if len(self.slow_ranks):
                    slow = np.isin(rank[hit], self.slow_ranks)
                    keep &= ~slow | (np.diff(word[hit], prepend=-1) != 0)
                hit = hit[keep]
                sym[hit] = self.made[at[hit]]
                over[hit + 1] = True
            sym, word = sym[~over], word[~over]
        if not done_sym:
            return [[] for _ in words]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        sym, cuts = sym[by], np.searchsorted(of_part[word[by]], np.arange(len(words) + 1))
        out = [sym[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if (sym < 0).any() or (sym >= self.n).any():
            back = {int(self.char[c]): c for c in np.unique(code) if self.char[c] >= self.n}
            out = [[y for x in ids for y in ([x] if 0 <= x < self.n else [self.bytes[b] for b in chr(back[x] if x >= 0 else -1 - x).encode()])] for ids in out]
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text, each without its first mark; a word that begins with a line feed has none."""
        if self.lines and text[0] != " " and "  " not in text and MARK not in text:
            return text.replace("\n", " \n").split(" ")
        return [w[1:] if w[0] == MARK else w for w in self.words.findall(MARK + text.replace(" ", MARK))]

    def learn(self, split: list[list[str]]) -> dict[str, tuple[bytes, bytes]]:
        """Remember the words' ids and texts; those of long words are returned and not kept."""
        if self.held > CACHED_BYTES:
            self.ids_of.clear()
            self.text_of.clear()
            self.held = 0
        new, passing = list({w for words in split for w in words if w not in self.ids_of}), {}
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for w, ids in zip(part, self.merge([w if self.lines and w[:1] == "\n" else MARK + w for w in part]), strict=True):
                raw, text = ",".join(map(str, ids)).encode(), self.decode(ids)
                if len(w) > LONG_WORD:
                    passing[w] = raw, text
                else:
                    self.ids_of[w], self.text_of[w] = raw, text
                    self.held += len(raw) + len(text)
        return passing

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, the text's first mark included."""
        return b"".join([self.surface[i] for i in ids])

    def encode_decode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Per text: its ids in decimal, joined by commas, and the text that they decode to."""
        split = [self.split(t.decode()) if t else [] for t in texts]
        passing = self.learn(split)
        ids, text = self.ids_of, self.text_of
        if passing:
            ids, text = ({**known, **{w: x[k] for w, x in passing.items()}} for k, known in enumerate((ids, text)))
        return [(b",".join([ids[w] for w in words]), b"".join([text[w] for w in words])[1:]) for words in split]


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    """One codec per worker process."""
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (decimal, joined by commas) and decoded text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for b in text_batches(batches):
            rows = codec(path).encode_decode(binaries(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.count(b",") + 1 if i else 0 for i, _ in rows], pa.int64()), pa.array([i for i, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.binary())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_pieces, with SHA-256 digests in place of the ids and the text, so that nothing large leaves a task."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        for b in text_batches(batches):
            rows = codec(path).encode_decode(binaries(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.count(b",") + 1 if i else 0 for i, _ in rows], pa.int64()), *[pa.array([hashlib.sha256(r[k]).hexdigest() for r in rows]) if rows else pa.array([], pa.string()) for k in (0, 1)]], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
