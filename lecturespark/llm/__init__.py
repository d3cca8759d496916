"""Operators of a training-data pipeline: duplicates, leaks, languages, tokens, mixing, scoring."""
