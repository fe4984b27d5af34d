"""sahifa: a PySpark-native engine for analysing and preparing classical-Arabic text at scale."""

__version__ = "0.1.0"
