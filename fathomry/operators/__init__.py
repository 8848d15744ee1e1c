"""Operators over DataFrames; each takes and returns relations, batches of queries included."""
