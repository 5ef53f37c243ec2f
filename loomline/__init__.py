"""Timed-text notes and transcripts on Spark: store, clean, segment, search, summarise."""

__version__ = "0.1.0"
