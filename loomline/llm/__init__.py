"""Operators for training-data text and speech pipelines. Nothing else in the library imports this subpackage."""
