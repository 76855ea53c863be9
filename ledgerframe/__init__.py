"""A Spark-native engine for document ledgers: text quality, reconciliation, repair, backup and audit."""

__version__ = "0.1.0"
