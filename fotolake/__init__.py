"""Spark-native analytics for photo and media catalogs."""
