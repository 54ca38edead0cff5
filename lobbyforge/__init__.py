"""PySpark-native board analytics engine."""
