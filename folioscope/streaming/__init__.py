"""Streaming of the manuscript analytics engine."""
