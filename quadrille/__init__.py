"""Adaptive-resolution raster analytics on Spark DataFrames."""
