"""Signature analytics on PySpark."""
