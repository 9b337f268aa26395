"""Operators of the manuscript analytics engine."""
