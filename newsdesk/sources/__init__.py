"""Readers of fixed dimensions, feed payloads, parameters and state tables."""
