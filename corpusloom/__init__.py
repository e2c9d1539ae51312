"""Spark-native analytics over stored web pages and document collections."""
