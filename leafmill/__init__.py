"""Leafmill: a PySpark-native engine for long-form text and reading analytics."""
