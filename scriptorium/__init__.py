"""A PySpark-native engine for searching and exploring media-transcript catalogues."""
