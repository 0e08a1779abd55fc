"""lodeseek: a PySpark-native hybrid retrieval engine for source code and text."""

__version__ = "0.1.0"
