"""Spherical analytics on Spark: geometry as DataFrame columns, cells as 64-bit keys."""
