"""Stateless transforms on Structured Streaming."""
