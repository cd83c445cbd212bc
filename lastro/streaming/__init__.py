"""Append from landing folders with Structured Streaming."""
