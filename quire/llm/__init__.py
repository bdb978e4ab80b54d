"""Operators of a training-data pipeline (see README): nothing outside this package imports it."""
