"""Spark-native knowledge-graph memory and recall."""
