"""Readers of landed files and payload columns, and the stored tables."""
