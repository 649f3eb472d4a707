"""Signature analytics on Spark: score feature sets, build neighbour graphs, test groups."""
