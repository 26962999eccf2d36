"""Operators of a training-data pipeline: tokens, duplicates, scans, classifiers."""
