"""kronika: a Spark-native engine for paged documents, retrieval and event records."""

__version__ = "0.1.0"
