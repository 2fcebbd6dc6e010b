"""Spark-native document-fact analytics: facts, checks, retrieval and traces as DataFrames."""
