"""urbanloom: a PySpark-native analytics engine for urban and spatial planning."""

__version__ = "0.1.0"
