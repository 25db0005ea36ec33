"""Structured Streaming over growing slow logs."""
