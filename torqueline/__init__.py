"""Spark-native diagnostic analytics: profiles, knowledge graph, retrieval and decisions on DataFrames."""
