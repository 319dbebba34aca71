"""Structured Streaming operators of lexspark."""
