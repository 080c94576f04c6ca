"""Spark-native analytics that turn structured text into a verified, queryable knowledge graph."""

__version__ = "0.1.0"
