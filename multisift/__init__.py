"""Spark-native multiplet analytics for single-cell count matrices and fragment tables."""
