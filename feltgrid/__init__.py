"""Panels, anomalies, keywords and clusters of emotion-scored posts, on Spark DataFrames."""

from feltgrid.domain import EMOTIONS, PROVINCES

__all__ = ["EMOTIONS", "PROVINCES"]
