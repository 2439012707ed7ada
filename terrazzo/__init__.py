"""terrazzo: a PySpark-native engine for feature queries and spatial analytics."""
