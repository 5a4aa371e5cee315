"""Operators of a training-data pipeline: filtering, de-duplication, extraction, encoding and packing."""
