"""Structured Streaming counterparts of the periodic run."""
