"""textloom: a PySpark-native analytics engine for longitudinal, timestamped text records."""

__version__ = "0.1.0"
