"""lorekeep: a PySpark-native analytics engine for text memories."""

__version__ = "0.1.0"
