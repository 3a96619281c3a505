"""Mangrove: declarative document queries and training-data operators on PySpark."""
