"""Compositions of operators into the reference's jobs."""
