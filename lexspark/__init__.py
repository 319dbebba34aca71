"""lexspark: a PySpark-native analytics engine for historical word records."""

__version__ = "0.1.0"
