"""Readers and writers (survey section 2.1) and the test-table fixtures."""
