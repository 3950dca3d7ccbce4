"""Spark-native entity resolution: blocking, features, matching, evaluation."""
