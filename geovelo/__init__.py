"""Spark-native near-surface ground characterisation."""
