"""Operators of a training-data pipeline: counts, scores, joins, dedup, extraction and token files."""
