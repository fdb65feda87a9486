"""lumenlog: a Spark-native analytics engine for conversation logs."""

__version__ = "0.1.0"
