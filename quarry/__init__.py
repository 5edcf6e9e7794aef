"""Spark-native document-structure analytics: plans are DataFrames, keyed by document."""
