"""A PySpark-native analytics engine for interval event streams."""
