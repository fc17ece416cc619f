"""Corpus processing, retrieval and analytics as PySpark DataFrame operators."""
