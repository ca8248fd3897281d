"""Tidemark: a PySpark-native engine for permission-aware, multilingual site search and indexing."""
