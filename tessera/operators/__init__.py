"""Operators on rasters."""
