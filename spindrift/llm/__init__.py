"""Operators a training-data pipeline needs, with their queries and reference SQL."""
