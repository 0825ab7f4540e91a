"""Quarrylight: a Spark-native analytics engine over source repositories."""

__version__ = "0.1.0"
