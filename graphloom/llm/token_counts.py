"""Token counts through a digest cache.

The cache is a folder of counts by SHA-256 of the content, one subfolder for each version of a tokenizer (the digest of its
file, library and settings), so a changed tokenizer never finds the counts of another. Documents are joined with it by
digest; of the digests it lacks, one text each is encoded and the counts are appended; then every document takes its
count from the cache. Digests that may hold 1/(2 * heavy) of the rows or more (at most 4 * heavy, by Misra-Gries) are
treated apart: their documents meet the counts in a broadcast, and their texts are thinned out in two steps, so no group
of copies gathers in one task. Texts are thinned within each scan task before they are shuffled at all.

An append that is lost with its job is made good by the next run, as its digests are then missing; one that is made twice
does no harm, as counts of one digest are equal and read once. Readers see whole files only.

Defined results: a null text counts as empty (0 bytes, 0 tokens); equal texts, byte for byte, are encoded once and count
alike; rows that repeat an id, or lack one, come back as they are; a text of any length is encoded whole; an empty table
gives an empty result and appends nothing. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import lru_cache
from importlib.metadata import version as installed

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, shared_dir, text_batches
from .exact_dedup import frequent

#: Misses up to this many are broadcast to drop known texts before the shuffle; more meet the texts in a shuffled join.
FEW_MISSES = 1 << 16
REMEMBERED, LONGEST = 1 << 18, 64
STORED = "digest binary, n_tokens long"

_SPACE = "\t\n\x0b\x0c\r "
_SEGMENT = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: What some definition of white space includes beside these six; a text with any of them is given to the library whole.
_DOUBTFUL = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF])) + "]")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, its library and the settings of the counts."""
    with open(path, "rb") as f:
        body = hashlib.sha256(f.read()).hexdigest()
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{body} {library} {installed(library)} no special tokens added, whole texts".encode()).hexdigest()


class Counter:
    """Token counts of texts, equal to the library's; counts of short segments are remembered, up to a number of them.

    A byte-level tokenizer that splits by its own pattern never joins a non-space with a space that follows it, so what
    lies between such places can be counted alone. Any other tokenizer gets the texts whole.
    """

    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        self.by_segment = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        pre = j.get("pre_tokenizer") or {}
        added = j.get("added_tokens") or []
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)
        self.by_segment = plain and not j.get("normalizer") and not j.get("post_processor") and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space") and j["model"]["type"] == "BPE" and not j["model"].get("dropout")

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        cut = [self.by_segment and not _DOUBTFUL.search(t) for t in texts]
        whole = [i for i, c in enumerate(cut) if not c]
        if whole:
            for i, n in zip(whole, self.whole([texts[i] for i in whole]), strict=True):
                out[i] = n
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        memo = self.memo
        segments = [_SEGMENT.findall(t) if c else [] for t, c in zip(texts, cut, strict=True)]
        new = list({s for found in segments for s in found if s not in memo and len(s) <= LONGEST})
        memo.update(zip(new, self.whole(new), strict=True))
        for i, found in enumerate(segments):
            try:
                out[i] += sum(map(memo.__getitem__, found))
            except KeyError:  # segments too long to be remembered
                long = [s for s in found if len(s) > LONGEST]
                out[i] += sum(self.whole(long)) + sum(memo[s] for s in found if len(s) <= LONGEST)
        return out


@lru_cache(4)
def counter(path: str, version: str) -> Counter:
    """One counter per worker process and version."""
    if tokenizer_version(path) != version:
        raise ValueError(f"{path} differs from the driver's")
    return Counter(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one version, each digest once."""
    path = f"{cache}/tokenizer={version}"
    if not _exists(spark, path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _one_each(texts: DataFrame, names: DataFrame) -> DataFrame:
    """One row of each digest; those of `names` are thinned out by task first."""
    cold = texts.join(F.broadcast(names), "digest", "left_anti").dropDuplicates(["digest"])
    if names.isEmpty():
        return cold
    hot = texts.join(F.broadcast(names), "digest", "left_semi").withColumn("salt", F.spark_partition_id() % 64)
    return cold.unionByName(hot.dropDuplicates(["digest", "salt"]).drop("salt").dropDuplicates(["digest"]))


def add_missing(texts: DataFrame, misses: DataFrame, names: DataFrame, path: str, cache: str, version: str) -> int:
    """Encode one text of each missing digest and append the counts; the number of digests."""
    n = misses.count()
    if not n:
        return 0
    if n <= FEW_MISSES:
        fresh = _one_each(texts.join(F.broadcast(misses), "digest", "left_semi"), names)
    else:
        fresh = _one_each(texts, names).join(misses, "digest", "left_semi")

    def encode(batches):
        for b in text_batches(batches):
            n = counter(path, version).counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    fresh.mapInArrow(encode, STORED).write.mode("append").option("compression", "zstd").parquet(f"{cache}/tokenizer={version}")
    return n


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 512, heavy: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, cached (its count was there before this run)."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    rows = materialize(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")), "counts-digests")
    names = materialize(frequent(rows, heavy), "counts-frequent")
    known = stored(spark, cache, version)
    hot_names = rows.join(F.broadcast(names), "digest", "left_semi").select("digest").distinct()
    distinct = rows.join(F.broadcast(names), "digest", "left_anti").select("digest").distinct().unionByName(hot_names)
    misses = materialize(distinct.join(known, "digest", "left_anti"), "counts-misses")
    add_missing(docs.select(text.alias("text"), digest), misses, names, path, cache, version)
    counts = stored(spark, cache, version).join(misses.withColumn("new", F.lit(True)), "digest", "left")
    hot = rows.join(F.broadcast(counts.join(F.broadcast(names), "digest", "left_semi")), "digest")
    cold = rows.join(F.broadcast(names), "digest", "left_anti").join(counts, "digest")
    return hot.unionByName(cold).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("new").isNull().alias("cached"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own for each call, so that every count is made by this call; a pipeline would pass one that stays."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
