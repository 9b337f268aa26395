"""Plans of the manuscript analytics engine."""
