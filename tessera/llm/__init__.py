"""Operators of a training-data pipeline: mixing, joins, redaction, scans, scoring, packing."""
