"""Spark-native xBase analytics: DBF source, compact SELECT dialect, compound-index pruning and data-quality operators."""

__version__ = "0.1.0"
