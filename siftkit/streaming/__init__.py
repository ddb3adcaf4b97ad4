"""Structured Streaming forms of the screening job (L1-L4)."""
