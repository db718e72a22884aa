"""Spark-native analytics for nucleic-acid triplex search and its evaluation."""
