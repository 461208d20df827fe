"""Cairnfield: a PySpark-native engine for clinical documents, patient records and training text."""
