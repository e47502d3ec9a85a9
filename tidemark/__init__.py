"""Audience analytics as PySpark plans."""
