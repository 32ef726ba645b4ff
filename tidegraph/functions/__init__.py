"""Part of the dated-graph engine."""
