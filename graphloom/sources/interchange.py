"""The graph as JSON, with names in place of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators.mutate import resolved, upsert_entities, upsert_properties
from ..tables import written

SCHEMAS = {
    "entities": "name string, type string, description string",
    "relationships": "source string, relation string, target string, weight double",
    "properties": "entity string, key string, value string",
}


def graph_export(graph: Graph) -> dict[str, DataFrame]:
    """One table for each array of the interchange format."""
    who = graph.entities.select("id", F.col("name").alias("entity"))
    return {
        "entities": graph.entities.select("name", "type", "description"),
        "relationships": graph.named_edges().select("source", "relation", "target", "weight"),
        "properties": graph.properties.join(who, F.col("entity_id") == F.col("id")).select("entity", "key", "value"),
    }


def write_export(graph: Graph, folder: str) -> None:
    """A JSON-lines dataset for each array."""
    for name, rows in graph_export(graph).items():
        rows.write.json(f"{folder}/{name}")


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def read_single_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The format as one JSON document with three arrays, for small graphs."""
    schema = ", ".join(f"{n} array<struct<{s.replace(' ', ':').replace(',:', ',')}>>" for n, s in SCHEMAS.items())
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return {n: doc.select(F.explode(n).alias("x")).select("x.*") for n in SCHEMAS}


def graph_import(graph: Graph, tables: dict[str, DataFrame], as_of: str) -> Graph:
    """Entities first, then edges and properties whose ends resolve; given weights stay, the largest of an edge's."""
    graph = upsert_entities(graph, tables["entities"], as_of)
    graph = graph.with_(entities=written(graph.entities, "imported"))  # each end, fact and name looks into it
    key = ["source_id", "target_id", "relation"]
    given = resolved(graph, resolved(graph, tables["relationships"], "source", "source_id"), "target", "target_id").groupBy(*key).agg(F.max("weight").alias("weight"))
    fresh = given.join(graph.relationships.select(*key), key, "left_anti").select(*key, F.coalesce("weight", F.lit(1.0)).alias("weight"), F.lit(as_of).cast("date").alias("created"))
    facts = tables["properties"].withColumn("updated", F.lit(as_of).cast("date"))
    return upsert_properties(graph.with_(relationships=graph.relationships.unionByName(fresh)), facts)
