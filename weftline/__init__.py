"""weftline: a Spark-native engine for indexing, linking, comparing and searching source graphs and text corpora."""

__version__ = "0.1.0"
