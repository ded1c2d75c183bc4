"""Structured Streaming forms of the poll and drip cycles."""
