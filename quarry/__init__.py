"""Spark-native analytics over text corpora, their revisions and their SQL."""
