"""All queries over the graph model and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as X
from ..operators.recall import KEY, recall_context, recall_match
from . import audits, columns, graph, lessons, recall, sessions

MODULES = (columns, graph, recall, lessons, sessions, audits)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled context of every user message."""
    g, messages = X.graph(spark, sf_dir), X.spark_table(spark, sf_dir, "messages")
    return recall_context(g, recall_match(g, messages, True, *X.indexes(spark, sf_dir)).select(*KEY, "name", "rank")).drop("name", "description")
