"""Streams over the fetch log."""
