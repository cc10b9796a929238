"""Spark-native analytics over versioned, ordered object key spaces."""
