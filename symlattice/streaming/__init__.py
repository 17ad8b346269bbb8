"""Micro-batch re-indexing and sessions over streams."""
