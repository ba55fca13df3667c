"""Spark-native record matching, data-quality analytics and corpus preparation."""
