"""The graph: three tables, with fixed schemas and versioned storage."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = "id long, name string, type string, description string, created date, updated date, last_referenced timestamp"
RELATIONSHIPS = "source_id long, target_id long, relation string, weight double, created date"
PROPERTIES = "entity_id long, key string, value string, updated date"


@dataclass(frozen=True)
class Graph:
    """Entities (unique by lower name), directed weighted relationships, and properties."""

    entities: DataFrame
    relationships: DataFrame
    properties: DataFrame

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    def named_edges(self) -> DataFrame:
        """Relationships with the names and types of both ends."""
        side = lambda p: self.entities.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(p), F.col("type").alias(f"{p}_type"))
        return self.relationships.join(side("source"), "source_id").join(side("target"), "target_id")

    def property(self, key: str, alias: str | None = None) -> DataFrame:
        """(entity_id, value) of one key."""
        return self.properties.where(F.col("key") == key).select("entity_id", F.col("value").alias(alias or key))

    def obsolete_ids(self) -> DataFrame:
        return self.properties.where("key = 'status' AND value = 'obsolete'").select("entity_id").distinct()


def empty(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (ENTITIES, RELATIONSHIPS, PROPERTIES)))


def write_version(graph: Graph, root: str, version: int) -> None:
    """A new version directory; the one being read is never overwritten."""
    for name in ("entities", "relationships", "properties"):
        getattr(graph, name).write.mode("errorifexists").parquet(f"{root}/v{version:08d}/{name}")


def read_version(spark: SparkSession, root: str, version: int) -> Graph:
    return Graph(*(spark.read.parquet(f"{root}/v{version:08d}/{name}") for name in ("entities", "relationships", "properties")))
