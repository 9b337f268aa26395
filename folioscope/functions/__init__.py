"""Functions of the manuscript analytics engine."""
