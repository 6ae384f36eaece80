"""Labelled-message analytics as PySpark DataFrame operators."""
