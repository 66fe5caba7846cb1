"""Spark-native operators for auditing text classifiers and their corpora."""

__version__ = "0.1.0"
