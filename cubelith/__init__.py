"""Cubelith: lazy, grid-aware raster cubes on PySpark."""
