"""Newsdesk: pool, de-duplicate, read, rank, pace and route short text items on Spark."""
