"""Operators of a training-data pipeline on whole document tables."""
