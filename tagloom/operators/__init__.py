"""Operators on DataFrames: filters, joins, windows, audits, vocabularies, metrics, samples, segments and retrieval."""
