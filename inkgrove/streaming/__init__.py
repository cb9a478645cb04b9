"""Structured Streaming jobs over the edit log."""
