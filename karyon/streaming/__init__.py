"""Structured Streaming over arriving files, for the stateless stages."""
