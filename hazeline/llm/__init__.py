"""Operators of a training-data pipeline: de-duplication, filters, packing, formatting."""
