"""granary: a PySpark-native engine for corpora of text and source code."""

__version__ = "0.1.0"
