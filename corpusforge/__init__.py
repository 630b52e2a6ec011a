"""Spark-native preparation and analysis of annotated text corpora."""
