"""Corvane: a PySpark-native analytics engine for source repositories and text corpora."""
