"""Streaming search."""
