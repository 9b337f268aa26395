"""Sources of the manuscript analytics engine."""
