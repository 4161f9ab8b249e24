"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of every partition name the digests that could be frequent. Their exact winners (a table of at
most 2 * heavy rows) are broadcast, so copies of frequent texts are settled where they lie; all other digests meet in an
ordinary shuffle, in which no group is large.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal texts
the row with the largest doc_id stays (a null id is the smallest; of rows that also share the id exactly one stays); an
empty table gives an empty result; a text of any length is hashed whole. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import binaries, documents, materialize


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row_no, digest): SHA-256 of the normalised text of every row; row_no tells repeated rows apart."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.sha256(t.lower()).digest() for t in binaries(b.column("text"))], pa.binary())], ["doc_id", "digest"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("digest", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row_no", F.monotonically_increasing_id())


class MisraGries:
    """At most k counters; each count is too low by at most n / (k + 1)."""

    def __init__(self, k: int):
        self.k, self.counts = k, Counter()

    def add(self, items) -> None:
        self.counts.update(items)
        if len(self.counts) > self.k:
            cut = sorted(self.counts.values(), reverse=True)[self.k]
            self.counts = Counter({x: c - cut for x, c in self.counts.items() if c > cut})


def frequent(digest_rows: DataFrame, heavy: int) -> DataFrame:
    """Digests that could belong to at least 1/heavy of all rows; at most 2 * heavy of them."""
    k = 2 * heavy

    def run(batches):
        seen = MisraGries(k)
        for b in batches:
            seen.add(b.column("digest").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.counts), pa.binary()), pa.array(list(seen.counts.values()), pa.int64())], ["digest", "low"])

    least = max(2, -(-digest_rows.count() // k))
    return digest_rows.select("digest").mapInArrow(run, "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low")).where(F.col("low") >= least).select("digest")


def exact_dedup(docs: DataFrame, heavy: int = 512) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(digests(docs), "dedup-digests")
    names = materialize(frequent(rows, heavy), "dedup-frequent")
    best = F.max(F.struct("doc_id", "row_no"))
    winners = rows.join(F.broadcast(names), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    hot = rows.join(F.broadcast(winners), "digest")
    whole = Window.partitionBy("digest")
    cold = rows.join(F.broadcast(names), "digest", "left_anti").withColumns({"group_size": F.count(F.lit(1)).over(whole), "best": best.over(whole)})
    return hot.unionByName(cold).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row_no") == F.col("row_no")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
