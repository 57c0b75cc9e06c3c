"""Conversational-memory analytics as set-based Spark jobs."""

__version__ = "0.1.0"
