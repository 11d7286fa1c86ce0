"""Quarry: a PySpark-native analytics engine for question-and-document corpora."""
