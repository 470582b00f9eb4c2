"""Operators of a training-data pipeline: quality, extraction, duplicates, models, scans.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
