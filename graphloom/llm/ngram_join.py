"""N-gram Jaccard join with R-trees over count vectors.

A document's set holds its distinct shingles. Shingles are hashed into groups; the counts of the groups are a point, and
the summed coordinate minima of two points bound what the sets share; parity sketches of the sets bound it again. Equal
sets are one class (by two hashes of 64 bits). Classes are filed under the rarest shingles of a prefix, which spreads
them over tasks, and the files of a task are searched through one R-tree whose boxes hold a range of shingles and sizes
and the largest counts; surviving pairs are verified on the sets themselves. In a file of more than 64 classes, up to six
leading classes are first set against all others by the same bounds, so that a large group of near copies costs about a
pair each. Linked classes become components by joins. Shingles are 48-bit hashes of whole words' 64-bit hashes.

Defined results: words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; fewer words than a shingle has are one shingle; no
words or a null text give an empty set that links with nothing; component_id is the least doc_id reachable (nulls come
last); equal sets always link; repeated rows link with each other; texts of any length are read whole; an empty table
gives an empty result. drop_near_copies carries any other columns, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import binaries, discard, documents, materialize, mix, text_batches, words_of
from .setjoin import Rarity, Threshold, connected, count_tokens, maybe, segments_sorted, similar, sketches

HEAVY = 1024
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles of each text, ascending, and each one's text."""
    h, cuts = words_of(texts, True)
    n = np.diff(cuts)
    v = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        v = mix(v + h[i : len(h) - k + 1 + i] * _ODD[i % len(_ODD)]) if len(v) else v
    doc = np.repeat(np.arange(len(n)), n)
    ok = np.flatnonzero(np.arange(len(v)) + k <= cuts[doc[: len(v)] + 1])
    values, owner = [v[ok]], [doc[ok]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        x = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for y in h[cuts[d] : cuts[d + 1]]:
                x = mix(np.array([x * _ODD[0] + y]))[0]
        values.append(np.array([x]))
        owner.append(np.array([d]))
    return segments_sorted(np.concatenate(values) >> np.uint64(16), np.concatenate(owner))


def signatures(values: np.ndarray, cuts: np.ndarray, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of each non-empty set; 0 for empty ones. Another salt gives an independent hash."""
    c = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(salt << 56)))])
    n = np.diff(cuts).astype(np.uint64)
    return np.where(n > 0, mix(c[cuts[1:]] - c[cuts[:-1]] + n), np.uint64(0))


def class_rows(docs: DataFrame, k: int, t: Threshold, rarity: Rarity, groups: int) -> DataFrame:
    """Per document: doc_id, text_hash, n, id of its class, prefix and count vector."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("proof", T.LongType()), T.StructField("prefix", T.BinaryType()), T.StructField("vector", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        for b in text_batches(batches):
            texts = binaries(b.column("text"))
            values, owner = shingles(texts, k)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            n = np.diff(cuts)
            ordered = np.sort((owner.astype(np.uint64) << np.uint64(48)) | rarity.order(values)) & np.uint64((1 << 48) - 1)
            p = np.where(n > 0, t.probe(n), 0)
            counts = np.bincount(owner * groups + (values % np.uint64(groups)).astype(np.int64), minlength=len(texts) * groups).astype(np.uint32).reshape(len(texts), groups)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int32()), *[pa.array(signatures(values, cuts, s).view(np.int64)) for s in (1, 2)], pa.array([ordered[c : c + m].tobytes() for c, m in zip(cuts, p, strict=False)], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(sketches(values, cuts), pa.binary())], schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def ngram_join(docs: DataFrame, k: int = 3, least: Fraction = Fraction(90, 100), groups: int = 32) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    t = Threshold(least)

    def tokens_of(batch):
        for b in text_batches([batch]):
            yield shingles(binaries(b.column("text")), k)[0]

    rarity = Rarity(count_tokens(docs.select("text"), tokens_of))
    rows = materialize(class_rows(docs, k, t, rarity, groups), "ngram-rows")
    full = rows.where("n > 0")
    classes = materialize(full.groupBy("id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("vector").alias("vector"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"), F.min("proof").alias("proof"), F.count(F.lit(1)).alias("copies")).select("id", "proof", "copies", "n", "prefix", "vector", "sketch", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62)).alias("doc"), F.lit(0).alias("line"), F.col("id").alias("state"), "doc_id"), "ngram-classes")

    def sets_of(known):
        def run(batches):
            for b in text_batches(batches):
                texts = binaries(b.column("text"))
                values, owner = shingles(texts, k)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                ids = signatures(values, cuts)
                use = np.flatnonzero(maybe(known, ids) & (np.diff(cuts) > 0))
                use = use[np.unique(ids[use], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[use].view(np.int64)), pa.array([values[cuts[i] : cuts[i + 1]].tobytes() for i in use], pa.binary())], ["id", "tokens"])

        return docs.select("text").mapInArrow(run, "id long, tokens binary").groupBy("id").agg(F.first("tokens").alias("tokens"))

    settle = lambda links: connected(links).select(F.col("node").alias("id"), F.col("root").alias("state"))
    links = similar(classes.drop("doc_id", "proof", "copies"), sets_of, t, True, True, settle)
    reached = connected(links)
    roots = classes.select("id", "doc_id", "copies", F.col("proof").alias("own")).join(reached.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = materialize(roots.join(names, "root").select("id", "own", "copies", "component_id"), "ngram-components")
    discard(links, reached, classes)
    heavy = F.broadcast(by_class.where(F.col("copies") >= max(2, -(-rows.count() // HEAVY))))  # at most HEAVY classes
    short = rows.select("doc_id", "text_hash", "n", "id", "proof")
    rest = short.join(heavy.select("id"), "id", "left_anti").join(by_class, "id", "left")
    same = (F.col("n") > 0) & (F.col("proof") == F.col("own"))
    return short.join(heavy, "id").unionByName(rest).select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(same, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, least: Fraction = Fraction(80, 100), groups: int = 32) -> DataFrame:
    """The documents with one row of each component left: the one with the least doc_id (of equal ids, any one)."""
    found = ngram_join(docs, k, least, groups)
    w = Window.partitionBy("component_id").orderBy("doc_id", "text_hash")
    kept = found.where("n_shingles > 0").withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    said = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(said).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    some = rows.join(kept, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")), "left_semi").dropDuplicates(["row_id", "row_hash"]).select("row.*")
    return some.unionByName(docs.where(~said))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
