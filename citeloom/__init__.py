"""Spark-native hybrid retrieval and citation-graph analytics."""
