"""Spark-native aerial-survey analytics: point clouds, grids, control points, terrain products."""

__version__ = "0.1.0"
