"""Raster time-series fusion on Spark."""
