"""Quern: a PySpark-native analytics engine. Every operator is a plan of DataFrame operations."""
