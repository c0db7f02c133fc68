"""Structured Streaming forms of the discovery pipeline."""
