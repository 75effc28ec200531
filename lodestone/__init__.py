"""Lodestone: Spark-native analytics for code and text corpora."""
