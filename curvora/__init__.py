"""Curve, raster and profile analytics on Spark DataFrames."""
