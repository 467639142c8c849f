"""Operators of a training-data pipeline: scans, joins, searches, extraction, mixing and classifiers.

Nothing outside this subpackage imports it.
"""
