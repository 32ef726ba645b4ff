"""Spark-first analytics for dated directed graphs and, in its own subpackage, training-data preparation."""
