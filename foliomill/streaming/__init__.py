"""Streaming of the corpus library."""
