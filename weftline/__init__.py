"""A PySpark-native engine for web archives and training corpora."""
