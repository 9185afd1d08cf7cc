"""Spark operators of starbraid: see the modules."""
