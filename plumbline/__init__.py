"""Drift and model-monitoring analytics as PySpark DataFrame operators."""
