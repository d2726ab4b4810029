"""lexloom: a PySpark-native analytics engine for multilingual document corpora."""

__version__ = "0.1.0"
