"""Spark-native intake of messy tabular data: profile, structure, clean, load, browse, change."""

from rowmill.options import ImportOptions
from rowmill.session import configure, get_session

__all__ = ["ImportOptions", "configure", "get_session"]
