"""weblume: a PySpark-native quality-analytics engine for web and open-data content."""

__version__ = "0.1.0"
