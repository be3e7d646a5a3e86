"""millrace: a Spark-native engine for building, auditing and scoring text corpora."""

__version__ = "0.1.0"
