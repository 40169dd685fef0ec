"""Operators that a training-data pipeline needs, each a Spark job of its own."""
