"""A training corpus in five stages, each on all that the one before it kept.

Toxic documents go; lines that repeat an earlier line go; one document of each group of near copies stays; spans of 50
words that an earlier document has go; the rest is packed into sequences. All stages but the last return the columns of
documents; where a text changes, n_chars follows it, and a document of which nothing is left goes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.ngram_join import drop_near_copies
from graphloom.llm.packing import pack_documents
from graphloom.llm.substring_dedup import substring_dedup
from graphloom.llm.toxicity import drop_toxic


def _changed(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, with the text that is left."""
    cut = F.col("n_removed") > 0
    own = {c: F.col("carried").getField(c) for c in _others(docs)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return out.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[own[c].alias(c) for c in docs.columns])


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _changed(docs, line_dedup(docs, carry=_others(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _changed(docs, substring_dedup(docs, carry=_others(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("substring dedup", spans), ("best-fit packing", packing)]

#: Encoding and best-two-fit can't be said in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
