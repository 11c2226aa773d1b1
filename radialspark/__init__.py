"""Periodic shell-count analytics on PySpark."""
