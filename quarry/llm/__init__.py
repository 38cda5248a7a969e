"""Operators for preparing training data: filters, joins, scans and formats over whole tables."""
