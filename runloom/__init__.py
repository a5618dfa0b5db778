"""Spark-native analytics over run-length Burrows-Wheeler relations."""
