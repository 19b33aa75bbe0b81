"""corpusmill: a Spark-native engine for preparing speech and text corpora."""

__version__ = "0.1.0"
