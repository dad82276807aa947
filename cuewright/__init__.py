"""Spark-native indexing, search and preparation of multimodal media metadata."""

__version__ = "0.1.0"
