"""Reading and writing rasters."""
