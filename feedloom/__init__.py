"""Spark-native curation of feeds of short documents."""
