"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words. Lines with the same tokens are one class; classes too short to match any other
class (at 0.8, those of one to three tokens) are settled by that, without pairs. The others are joined by prefix,
positional and length filters over rarest-first tokens (and by the parity of hashed tokens, which bounds the symmetric
difference); Jaccard is verified on the tokens. A line goes when a line that comes before it, by doc_id and line number,
reaches the threshold; lines are judged on the input, so the order of work doesn't matter.

Defined results: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; lines end at line feeds; lines with fewer than
`fewest` distinct words stay and match nothing (with the default of 1, blank lines only); a null text counts as empty;
rows with a null doc_id keep all lines and match nothing; of equal lines the first by doc_id and line number stays; rows
with the same id and text have the same result; texts and lines of any length are read whole; an empty table gives an
empty result. With `carry`, other columns come in one struct, whatever their names.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binaries, carried, discard, documents, hash_words, materialize, mix, text_batches
from .ngram_join import signatures
from .setjoin import Rarity, Threshold, count_tokens, maybe, segments_sorted, similar

LIMIT, HEAVY = 60_000, 1024


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, each one's line (counted through all texts), and the first line of each text."""
    whole = b"\n".join(texts)
    s, _, h = hash_words(whole, True)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(whole, np.uint8) == 10), s)
    return h, line, np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])])


def line_sets(texts: list[bytes], fewest: int):
    """Blocks of (text number, line number, distinct 48-bit words, where each line's begin), for lines with enough words."""
    h, line, offsets = lines_of(texts)
    first = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(line))
    lines = line[first[:-1]]
    for at in range(0, len(lines), LIMIT):
        own = lines[at : at + LIMIT]
        a, b = first[at], first[min(at + LIMIT, len(lines))]
        values, owner = segments_sorted(h[a:b] >> np.uint64(16), np.repeat(np.arange(len(own)), np.diff(first[at : at + len(own) + 1])))
        cuts = np.searchsorted(owner, np.arange(len(own) + 1))
        ok = np.diff(cuts) >= fewest
        keep = ok[owner]
        text = np.searchsorted(offsets, own, "right") - 1
        yield text[ok], (own - offsets[text])[ok], values[keep], np.concatenate([[0], np.cumsum(np.diff(cuts)[ok])])


def line_rows(docs: DataFrame, t: Threshold, rarity: Rarity, fewest: int) -> DataFrame:
    """(doc_id, text_hash, line, id, proof, n, prefix, vector); `proof` is a second hash of the line's words."""
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "text_hash": T.LongType(), "line": T.IntegerType(), "id": T.LongType(), "proof": T.LongType(), "n": T.IntegerType(), "prefix": T.BinaryType(), "vector": T.BinaryType()}

    def run(batches):
        for b in text_batches(batches):
            for text, line, values, cuts in line_sets(binaries(b.column("text")), fewest):
                at, n = pa.array(text), np.diff(cuts)
                owner = np.repeat(np.arange(len(n)), n)
                ordered = np.sort((owner.astype(np.uint64) << np.uint64(48)) | rarity.order(values)) & np.uint64((1 << 48) - 1)
                h = mix(values)
                bit = np.uint64(1) << (h & np.uint64(63))
                halves = np.stack([np.where((h >> np.uint64(6)) & np.uint64(1) == k, bit, np.uint64(0)) for k in (0, 1)], 1)
                parity = np.bitwise_xor.reduceat(halves, cuts[:-1], axis=0) if len(n) else np.zeros((0, 2), np.uint64)
                prefix = [ordered[c : c + p].tobytes() for c, p in zip(cuts, np.where(t.alone(n), 0, t.probe(n)), strict=False)]
                raw = parity.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("text_hash").take(at), pa.array(line, pa.int32()), *[pa.array(signatures(values, cuts, k).view(np.int64)) for k in (1, 2)], pa.array(n, pa.int32()), pa.array(prefix, pa.binary()), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())],
                    list(kinds),
                )

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, T.StructType([T.StructField(x, k) for x, k in kinds.items()]))


def line_words(docs: DataFrame, known: np.ndarray, fewest: int) -> DataFrame:
    """(id, tokens): the distinct words of each line whose id the filter may hold."""

    def run(batches):
        for b in text_batches(batches):
            texts = binaries(b.column("text"))
            parts = {}
            for text, line, values, cuts in line_sets(texts, fewest):
                ids = signatures(values, cuts)
                use = np.flatnonzero(maybe(known, ids))
                use = use[np.unique(ids[use], return_index=True)[1]]
                words = []
                for i, j in zip(text[use].tolist(), line[use].tolist(), strict=True):
                    if i not in parts:
                        parts = {i: texts[i].lower().split(b"\n")}
                    words.append(b" ".join(set(parts[i][j].split())))
                yield pa.RecordBatch.from_arrays([pa.array(ids[use].view(np.int64)), pa.array(words, pa.binary())], ["id", "tokens"])

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text").mapInArrow(run, "id long, tokens binary").groupBy("id").agg(F.first("tokens").alias("tokens"))


def repeated_lines(docs: DataFrame, least: Fraction, fewest: int) -> DataFrame:
    """(doc_id, text_hash, gone): the numbers of the lines that go."""
    t = Threshold(least)

    def tokens_of(batch):
        for b in text_batches([batch]):
            yield hash_words(b"\n".join(binaries(b.column("text"))), True)[2] >> np.uint64(16)

    rarity = Rarity(count_tokens(docs.where(F.col("doc_id").isNotNull()).select("text"), tokens_of, 1 << 20))
    rows = materialize(line_rows(docs, t, rarity, fewest), "line-rows")
    first = F.min(F.struct("doc_id", "line", "proof")).alias("e")
    classes = rows.groupBy("id").agg(first, F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "prefix", "vector")])
    classes = materialize(classes.select("id", "copies", "n", "prefix", "vector", F.col("e.proof").alias("proof"), F.col("e.doc_id").cast("long").alias("doc"), F.col("e.line").alias("line"), F.lit(0).cast("long").alias("state")), "line-classes")
    lines = materialize(rows.select("doc_id", "text_hash", "line", "id", "proof"), "line-ids")  # prefixes and vectors are the classes' only from here on
    discard(rows)
    settle = lambda links: links.select(F.col("b").alias("id")).distinct().withColumn("state", F.lit(1).cast("long"))
    linked = similar(classes.where("length(prefix) > 0").drop("copies", "proof"), lambda known: line_words(docs, known, fewest), t, False, False, settle)
    later = linked.select(F.col("b").alias("id")).distinct().withColumn("later", F.lit(True))
    judged = classes.select("id", "copies", F.col("proof").alias("own"), F.struct("doc", "line").alias("e")).join(later, "id", "left").where("later OR copies > 1")
    judged = materialize(judged, "line-judged")
    discard(linked, classes)
    heavy = F.broadcast(judged.where(F.col("copies") >= max(2, -(-lines.count() // HEAVY))))  # at most HEAVY classes
    here = F.struct(F.col("doc_id").cast("long").alias("doc"), "line")
    gone = lambda df: df.where((F.col("proof") == F.col("own")) & (F.coalesce("later", F.lit(False)) | (here > F.col("e")))).select("doc_id", "text_hash", "line")
    common = gone(lines.join(heavy, "id"))
    rare = gone(lines.join(heavy.select("id"), "id", "left_anti").join(judged, "id"))
    return common.unionByName(rare).groupBy("doc_id", "text_hash").agg(F.collect_list("line").alias("gone"))


def line_dedup(docs: DataFrame, least: Fraction = Fraction(80, 100), fewest: int = 1, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256; with `carry` also the struct `carried` of those columns and the kept text."""
    docs, others = carried(docs, carry)
    gone = repeated_lines(docs.select("doc_id", "text"), least, fewest)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([*others, T.StructField("text", T.StringType())] if carry is not None else [])])

    def run(batches):
        for b in text_batches(batches):
            rows = []
            for t, lines in zip(binaries(b.column("text")), b.column("gone").to_pylist(), strict=True):
                parts, out = t.split(b"\n"), set(lines or ())
                kept = b"\n".join([x for i, x in enumerate(parts) if i not in out]) if out else t
                rows.append((len(parts), len(out), hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols[:3], *([*[b.column(f.name) for f in others], cols[3].cast(pa.string())] if carry is not None else [])], schema.names)

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", *[f.name for f in others])
    return texts.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", *[f.name for f in others], "gone").mapInArrow(run, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))
