"""Spark-native analytics over versioned dependency graphs."""
